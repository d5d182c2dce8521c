"""Codecs by name: of whole records (DataFrame to DataFrame) and of fields (Column to Column). Other packages add theirs as plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame

from ..picture import Field, Layout
from . import codec, files


@dataclass(frozen=True)
class RecordCodec:
    encode: Callable[[DataFrame, Layout], DataFrame]
    decode: Callable[[DataFrame, Layout], DataFrame]


@dataclass(frozen=True)
class FieldCodec:
    encode: Callable[[Column, Field], Column]
    decode: Callable[[Column, Field], Column]


RECORDS: dict[str, RecordCodec] = {
    "json": RecordCodec(lambda df, _: files.to_json(df), files.from_json),
    "xml": RecordCodec(lambda df, lay: files.to_xml(df, lay.name), lambda df, lay: files.from_xml(df, lay, lay.name)),
    "fixed": RecordCodec(codec.to_records, codec.records),
    "ebcdic": RecordCodec(lambda df, lay: codec.to_records(df, lay, encoding="cp037"), lambda df, lay: codec.records(df, lay, encoding="cp037")),
}
FIELDS: dict[str, FieldCodec] = {"bytes": FieldCodec(codec.encoded, codec.decoded)}
#: Plug-ins are entry points of this group: a function that is called with this module.
GROUP = "ledgerframe.codecs"


def register(name: str, made: RecordCodec | FieldCodec) -> None:
    (RECORDS if isinstance(made, RecordCodec) else FIELDS)[name.lower()] = made


def load_plugins() -> list[str]:
    import sys

    found = list(entry_points(group=GROUP))
    for p in found:
        p.load()(sys.modules[__name__])
    return [p.name for p in found]


def encode(name: str, df: DataFrame, layout: Layout) -> DataFrame:
    return RECORDS[name.lower()].encode(df, layout)


def decode(name: str, df: DataFrame, layout: Layout) -> DataFrame:
    return RECORDS[name.lower()].decode(df, layout)
