"""Errors of codecs: a row that fails carries one instead of failing its task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes an error can have.
UNKNOWN, INTERNAL, INVALID, DEPRECATED, CORRUPTED, CLOSED, UNEXPECTED_EOF = "UNKNOWN", "INTERNAL", "INVALID", "DEPRECATED", "CORRUPTED", "CLOSED", "UNEXPECTED_EOF"
#: Spark type of the err field of results.
ERR = "struct<code:string,pkg:string,msg:string>"


class CodecError(Exception):
    """code: one of the classes; pkg: the codec; msg: what is wrong."""

    def __init__(self, code: str, msg: str = "", pkg: str = ""):
        super().__init__(": ".join(x for x in (pkg, code.lower().replace("_", " "), msg) if x))
        self.code, self.msg, self.pkg = code, msg, pkg

    def row(self, pkg: str) -> dict[str, str]:
        return {"code": self.code, "pkg": self.pkg or pkg, "msg": self.msg}


def corrupted(msg: str) -> CodecError:
    return CodecError(CORRUPTED, msg)


def is_code(result: str, code: str) -> Column:
    """Whether a result column's error is of a class; false where there is none."""
    return F.coalesce(F.col(f"{result}.err.code") == code, F.lit(False))


def is_corrupted(result: str) -> Column:
    return is_code(result, CORRUPTED)


def is_deprecated(result: str) -> Column:
    return is_code(result, DEPRECATED)


def is_invalid(result: str) -> Column:
    return is_code(result, INVALID)


def is_internal(result: str) -> Column:
    return is_code(result, INTERNAL)


def is_closed(result: str) -> Column:
    return is_code(result, CLOSED)


def is_truncated(result: str) -> Column:
    return is_code(result, UNEXPECTED_EOF)
