"""Ordered ignore rules: the last rule that matches decides."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import ancestors


def compiled(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression for whole paths, negated, directories only) of a rule line; None for blanks and comments."""
    text = line.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[negated:]
    only = text.endswith("/")
    text = text[:-1] if only else text
    anchored = "/" in text
    text = text.lstrip("/") if text.startswith("/") else text
    if not text:
        return None
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif text[i:] == "**" and i and text[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while text[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := text.find("]", i + 2 if text[i + 1 : i + 2] in "!^" else i + 1, len(text))) > i + 1:
            inside = text[i + 1 : end]
            inverse = inside[0] in "!^"
            body = re.sub(r"([\\\[&~])", r"\\\1", inside[inverse:])
            out, i = out + f"(?!/)[{'^' * inverse}{body}]", end + 1
        else:
            if c == "\\" and i + 1 < len(text):
                i += 1
                c = text[i]
            out, i = out + re.sub(r"([^A-Za-z0-9_/\u0080-\U0010ffff])", r"\\\1", c), i + 1
    return f"(?s)^{'' if anchored else '(?:.*/)?'}{out}$", negated, only


def ignored(path, directory, rules: list[str]):
    """Whether the rules, in order, ignore `path`; `directory`: whether it is one. Parents are not looked at."""
    out = F.lit(False)
    for line in rules:
        if rule := compiled(line):
            regex, negated, only = rule
            hit = path.rlike(regex) & directory if only else path.rlike(regex)
            out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def pruned(entries: DataFrame, rules: list[str]) -> DataFrame:
    """`entries` (path, kind) that a scan reaches, with `ignored`: nothing below an ignored directory is reached, whatever later rules say."""
    marked = entries.withColumn("ignored", ignored(F.col("path"), F.col("kind") == "directory", rules))
    cut = marked.where("ignored and kind = 'directory'").select(F.col("path").alias("_up"))
    paths = entries.select("path", F.explode(ancestors(F.col("path"))).alias("_up"))
    below = paths.join(cut, "_up", "left_semi").select("path").distinct()
    return marked.join(below, "path", "left_anti")
