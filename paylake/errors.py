"""Errors and verdicts as data."""

from __future__ import annotations

from enum import Enum, IntFlag

# Names of processing errors.
PROCESSING = (
    "unknown", "success", "file_open_failed", "mmap_failed", "xsd_validation_failed", "parse_failed", "worker_thread_error", "invalid_xpath",
    "schema_not_found", "xml_empty", "internal_error", "error_extracting_xpath_values", "syntax_error", "semantic_error",
)
# Names of export errors.
EXPORT = (
    "unknown", "file_open_failed", "file_write_failed", "file_move_failed", "file_rename_collision", "invalid_config", "wrk_start_failed",
    "fetch_doc_name_failed", "fetch_run_stat_failed", "fetch_doc_data_failed", "prepare_transaction_failed", "prepare_header_failed",
    "prepare_footer_failed", "document_rejected", "xml_writer_error", "cancelled",
)

ERROR_DDL = "struct<code:string,domain_code:string,message:string,path:string,line:int,column:int>"


class ErrorClass(IntFlag):
    """Why a document is rejected (all but TE) or blemished (TE)."""

    UA = 1  # unknown agent
    SE = 2  # not well-formed
    VE = 4  # violates the grammar
    HE = 8  # header or document rule
    TE = 16  # another segment


REJECTING = ErrorClass.UA | ErrorClass.SE | ErrorClass.VE | ErrorClass.HE


class ThreeState(str, Enum):
    UNKNOWN = "unknown"
    VALID = "valid"
    INVALID = "invalid"


class ExportError(RuntimeError):
    """Stops an export run; ``code`` is one of EXPORT."""

    def __init__(self, code: str, message: str):
        assert code in EXPORT
        super().__init__(f"[{code}] {message}")
        self.code = code


def render(code: str, message: str, domain_code: str | None = None, path: str | None = None, line: int | None = None) -> str:
    """An error as one line of text."""
    head = f"[{code}:{domain_code}]" if domain_code else f"[{code}]"
    where = ", ".join(x for x in (path and f"file: {path}", line and f"line: {line}") if x)
    return f"{head} {message}" + (f" ({where})" if where else "")
