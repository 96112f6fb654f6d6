from retailkit.sources.raw import RAW_SCHEMAS, read_raw
from retailkit.sources.adapter import Retail

__all__ = ["RAW_SCHEMAS", "read_raw", "Retail"]
