"""What a scan can raise."""


class ScanError(Exception):
    """A scan that can't be completed."""


class InvalidRoot(ScanError):
    """A project root that doesn't exist."""


class ScratchError(Exception):
    """No folder that all executors share."""
