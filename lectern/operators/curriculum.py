"""Order-dependent text machines: sections of a body, tables to session rows, layout of boxes, merges with an audit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_LABEL = re.compile(r"^\s*[-*•]?\s*([^:]{1,40}?)\s*:\s*(.*)$")
_HEADING = re.compile(r"^\s*(?:#+\s*([^#].*?)|\[\s*([^\]]+?)\s*\])\s*$")


def parse_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, position, label, value of each labelled line; unlabelled lines go on from the one before.

    Text before the first heading is the section ``intro``; a line without a
    label and without a value before it has a null label.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, body in zip(batch["key"], batch["text"], strict=True):
                section, items = "intro", []
                for line in (body or "").split("\n"):
                    if not line.strip():
                        continue
                    heading, labelled = _HEADING.match(line), _LABEL.match(line)
                    if heading:
                        section = heading[1] or heading[2]
                    elif labelled:
                        items.append([section, labelled[1], labelled[2].strip()])
                    elif items and items[-1][0] == section:
                        items[-1][2] = f"{items[-1][2]} {line.strip()}".strip()
                    else:
                        items.append([section, None, line.strip()])
                out += [(k, s, i, label, value) for i, (s, label, value) in enumerate(items)]
            yield pd.DataFrame(out, columns=[key, "section", "position", "label", "value"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, section string, position int, label string, value string")


def merge_items(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Labelled items of a base and a supplement (key, label, value): value and what became of it.

    The longer of two values that contain one another wins, differing ones are a
    conflict that keeps the base, labels of one side only are kept or added.
    """
    a = base.select(key, "label", F.col("value").alias("a"))
    b = more.select(key, "label", F.col("value").alias("b"))
    x, y = F.col("a"), F.col("b")
    bare = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    within = F.contains(bare(x), bare(y))
    around = F.contains(bare(y), bare(x))
    outcome = F.when(y.isNull(), "kept").when(x.isNull(), "added").when(within, "skipped").when(around, "extended").otherwise("conflict")
    return a.join(b, [key, "label"], "full_outer").select(key, "label", F.when(x.isNull() | (around & ~within), y).otherwise(x).alias("value"), outcome.alias("outcome"))


def repair_encoding(texts: Column) -> Column:
    """Text whose CP949 bytes were read as latin-1, read again; unchanged where that fails."""

    def one(value: str) -> str:
        try:
            return value.encode("latin-1").decode("cp949")
        except UnicodeError:
            return value

    def run(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return F.pandas_udf(run, StringType())(texts)
