"""Tables and requests of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Kinds of blocks.
KINDS = (
    "Class",
    "Interface",
    "Enum",
    "Method",
    "Constructor",
    "Field",
    "Annotation",
    "Import",
    "XmlNode",
    "XmlNamespace",
    "Other",
)

KEY = ["file_path", "start_line", "end_line"]

_S, _I = T.StringType(), T.IntegerType()
BLOCK = T.StructType(
    [
        T.StructField("file_path", _S, False),
        T.StructField("start_line", _I, False),
        T.StructField("end_line", _I, False),
        T.StructField("content", _S, False),
        T.StructField("language", _S, False),
        T.StructField("kind", _S, False),
        T.StructField("name", _S, False),
        T.StructField("parent", _S, True),
        T.StructField("signature", _S, True),
        T.StructField("annotations", T.ArrayType(_S, False), False),
        T.StructField("dependencies", T.ArrayType(_S, False), False),
    ]
)
#: Blocks as an index keeps them: tokens are made once, not for every search.
INDEXED = T.StructType([*BLOCK.fields, T.StructField("tokens", T.ArrayType(_S, False), True)])
VECTOR = T.StructType([*BLOCK.fields[:3], T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)])
FILE = T.StructType([T.StructField("path", _S, False), T.StructField("ext", _S, True), T.StructField("content", T.BinaryType(), True)])
CHANGE = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("path", _S, False),
        T.StructField("op", _S, False),
        T.StructField("content", T.BinaryType(), True),
    ]
)


@dataclass(frozen=True)
class Request:
    """One search: lang is a comma list, path a part of the file path, context 'full' or a line count."""

    query: str
    lang: str | None = None
    limit: int = 10
    context: str = "full"
    path: str | None = None

    def __post_init__(self) -> None:
        if self.limit < 0:
            raise ValueError("limit must not be negative")

    @property
    def context_lines(self) -> int | None:
        digits = self.context[1:] if self.context.startswith("+") else self.context
        return int(digits) if digits.isascii() and digits.isdigit() else None

    @property
    def languages(self) -> list[str] | None:
        return None if self.lang is None else [x.strip() for x in self.lang.split(",")]
