"""Fill-in-middle transformation: texts cut at two unit ends drawn from a digest of their key.

A unit is white space and the word behind it, or white space at a text's end (white space: blank and code points 9 to 13).
Of a text with n units, the prefix ends after the smaller and the middle after the larger of two unit numbers, both drawn
from 0 to n; the suffix is the rest.  The draws are the first four 8-digit groups of the SHA-256 of ``seed:key``, so a
row's result depends on nothing but its key and text, and a recomputed task gives the same rows.

Forms: ``psm`` is ``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` is ``<S>``suffix``<P>``prefix``<M>``middle, ``plain`` is the text.
Empty texts and texts that hold one of the marks stay plain, so that every output can be undone: with no mark in the
text, none can arise where a slice meets a mark either.

A null text is an empty text.  A null key draws from the seed alone.  Repeated rows give repeated results; an empty table gives none.
Very long texts are held whole, with four bytes for each unit.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.storage import unused_name

# Units and marks.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

units = regex.compile(UNIT)
marks = regex.compile("|".join(map(regex.escape, (PREFIX, SUFFIX, MIDDLE))))


def unit_ends(text: str) -> array:
    """The offset behind each unit, in code points."""
    return array("I", (m.end() for m in units.finditer(text)))


def draws(seed: int, key: str) -> list[int]:
    """Four unsigned 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]


def transformed(text: str, key: str, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    ends = unit_ends(text)
    h = draws(seed, key)
    if not text or h[2] % 100 >= fim_percent or marks.search(text):
        return len(ends), "plain", None, None, text
    first, second = sorted((h[0] % (len(ends) + 1), h[1] % (len(ends) + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text behind an output."""
    if form == "plain":
        return output
    mark = SUFFIX if form == "psm" else PREFIX
    one, _, rest = output[len(PREFIX) :].partition(mark)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``; columns of these names are replaced."""
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = docs.drop(*(c for c in names if c not in (key, text)))

    @F.pandas_udf("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    def cut(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transformed(t or "", k or "", seed, fim_percent, spm_percent) for k, t in zip(keys, texts, strict=True)]
        out = pd.DataFrame(rows, columns=list(names))
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    both = unused_name(kept, "_cut")
    out = kept.withColumn(both, cut(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")))
    return out.select(*[F.col(f"`{c}`") for c in kept.columns if c not in names], *[F.col(f"`{both}`.{c}").alias(c) for c in names])


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; null where there is no output."""

    @F.pandas_udf("string")
    def undone(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restored(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return undone(output, form)


def digests(output: Column, form: Column) -> Column:
    """A struct of the SHA-256 of an output (``output_sha256``) and of the text restored from it (``restored_sha256``)."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def told(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        hexed = lambda texts: [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        return pd.DataFrame({"output_sha256": hexed(outputs), "restored_sha256": hexed(map(restored, outputs, forms))})

    return told(output, form)
