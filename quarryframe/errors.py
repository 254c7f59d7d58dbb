"""Errors that operators raise when a plan is built, and condition names for those found while it runs."""

from __future__ import annotations


class FrameError(ValueError):
    """Any misuse that is known before a job starts."""


class ColumnNotFound(FrameError):
    pass


class DuplicateColumn(FrameError):
    pass


class TypeMismatch(FrameError):
    pass


class TypeNotNumeric(FrameError):
    pass


class TypeNotCastable(FrameError):
    pass


class UnsafeCast(FrameError):
    pass


class InvalidQuantile(FrameError):
    pass


class IndexOutOfBounds(FrameError):
    pass


class InconsistentRowWidth(FrameError):
    pass


class EmptyInput(FrameError):
    pass


class RaggedFrame(FrameError):
    pass


class UnsupportedFileType(FrameError):
    pass


class CorruptFile(FrameError):
    pass
