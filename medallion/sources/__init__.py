from . import message_log
from .medical import MedicalTables
from .readers import decode_payload, read_csv, stream_source

__all__ = ["MedicalTables", "decode_payload", "read_csv", "stream_source"]
