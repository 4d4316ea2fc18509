"""Errors that reading an image can raise."""

from __future__ import annotations


class ImageError(Exception):
    """Any fault of an image or of its use."""


class SourceError(ImageError):
    """The bytes could not be read."""


class TruncatedHeader(ImageError):
    pass


class BadMagic(ImageError):
    pass


class NotAnImage(ImageError):
    """No section header was found."""


class UnsupportedVersion(ImageError):
    pass


class TruncatedSection(ImageError):
    pass


class CorruptSectionIndex(ImageError):
    pass


class IntegrityMismatch(ImageError):
    """A section's hash is not that of its bytes."""


class CapExceeded(ImageError):
    """Decoded data would be larger than allowed."""


class CodecDisabled(ImageError):
    """The codec's library is not installed."""


class CodecUnimplemented(ImageError):
    pass


class SourceOutOfBounds(ImageError):
    pass


class UnsupportedFeature(ImageError):
    pass


class UnknownCompression(ImageError):
    pass


class DecodeError(ImageError):
    """Bytes that are not what their place says."""


class EncodeError(ImageError):
    pass
