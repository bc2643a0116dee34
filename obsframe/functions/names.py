"""Header normalisation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def clean_name(name: str, case: str = "snake") -> str:
    text = name.replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    words = [w.lower() for w in re.split(r"[^A-Za-z0-9]+", text) if w]
    if not words:
        return "x"
    if words[0][0].isdigit():
        words[0] = "x" + words[0]
    if case == "sentence":
        return " ".join(words).capitalize()
    return "_".join(words)


def clean_names(df: DataFrame, case: str = "snake") -> DataFrame:
    """Rename every column to snake_case (or Sentence case); repeats get ``_2``, ``_3`` …"""
    sep = " " if case == "sentence" else "_"
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        new = clean_name(name, case)
        seen[new] = seen.get(new, 0) + 1
        out.append(new if seen[new] == 1 else f"{new}{sep}{seen[new]}")
    return df.toDF(*out)
