"""Intermediate tables of this subpackage's operators."""

from splatlake.functions.storage import discard, shared_dir, written

__all__ = ["discard", "shared_dir", "written"]
