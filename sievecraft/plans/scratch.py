"""Tables and files that queries write into the shared folder."""

from ..scratch import cut, shared_path

__all__ = ["cut", "shared_path"]
