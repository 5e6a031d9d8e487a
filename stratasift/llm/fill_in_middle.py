"""Fill-in-the-middle transformation of whole texts.

A text is cut at two boundaries of its units (words of ASCII letters, and every other code
point by itself) into prefix, middle and suffix, and put together again in another order with
marks between the parts, so that a model learns to write a middle from both sides. Which
boundaries, and which order, depends on a hash of the row's key only.

Offsets of all boundaries of a batch of texts go into a learned index
(:mod:`stratasift.llm.rank_index`), which then gives the two cuts of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasift.llm.common import map_slices, raw_text, text_input
from stratasift.llm.rank_index import fit

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all unit boundaries of all texts, and where each text's begin.

    A text of n units has n + 1 boundaries, its own first and last byte included.
    """
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80  # first bytes of code points
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    first = np.flatnonzero(begins)
    at = np.searchsorted(first, offsets)
    return np.insert(first, at[1:], offsets[1:]), at + np.arange(len(at))


def _transform(part: pa.RecordBatch) -> pa.RecordBatch:
    array = part.column("text")
    rows = len(array)
    data, offsets = raw_text(array)
    cuts, starts = boundaries(data, offsets)
    units = np.diff(starts) - 1
    index = fit(cuts, starts)
    draws = [part.column(f"h{i}").to_numpy(zero_copy_only=False) % (units + 1) for i in (1, 2)]
    a = index.offsets(starts[:-1] + np.minimum(*draws))
    b = index.offsets(starts[:-1] + np.maximum(*draws))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    forms = part.column("form").to_pylist()
    marks = [m.encode() for m in part.column("marks")[0].as_py()] if rows else [b""] * 3
    raw = data.tobytes()
    out, plain = [], np.zeros(rows, bool)
    spans = zip(forms, offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist())
    for i, (form, start, x, y, end) in enumerate(spans):
        text = raw[start:end]
        if not text or form == "plain" or any(m in text for m in marks):
            forms[i], plain[i] = "plain", True
            out.append(text)
            continue
        before, middle, after = raw[start:x], raw[x:y], raw[y:end]
        p, s, m = marks
        parts = (p, before, s, after, m, middle) if form == "psm" else (s, after, p, before, m, middle)
        out.append(b"".join(parts))
    return pa.RecordBatch.from_arrays(
        [
            part.column("key"),
            pa.array(units, pa.int64()),
            pa.array(forms, pa.string()),
            pa.array(points[a] - points[offsets[:-1]], pa.int64(), mask=plain),
            pa.array(points[b] - points[a], pa.int64(), mask=plain),
            pa.array(out, pa.binary()).cast(pa.string()),
        ],
        names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    transformed: int = 90,
    suffix_first: int = 20,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """One row per row: key, n, form, prefix_chars, middle_chars, output.

    ``n`` counts the units. ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix,
    prefix, middle) or ``plain``: the text as it was, for an empty or null text, one that
    holds a mark, and all but ``transformed`` per cent of the rows. ``suffix_first`` is the
    percentage of spm among the others. Draws are the first four 32-bit numbers of the
    sha256 of "seed:key", so equal keys have equal draws, and a null key counts as empty
    text; repeated rows give repeated results. Prefix and middle may be empty, and are null
    where the form is plain. Only the key and these columns are returned, whatever other
    columns ``docs`` has. No two marks may hold one another or overlap, as a reader could
    not tell the parts apart.
    """
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            overlap = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b)))
            if not a or (i != j and (a in b or overlap)):
                raise ValueError(f"marks {marks} cannot be told apart")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    form = (
        F.when(draws[2] % 100 >= transformed, "plain").when(draws[3] % 100 < suffix_first, "spm").otherwise("psm")
    )
    rows = text_input(
        docs, key, text, draws[0].alias("h1"), draws[1].alias("h2"), form.alias("form"),
        F.array(*map(F.lit, marks)).alias("marks"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_slices(rows, _transform, schema).withColumnRenamed("key", key)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which ``output`` was made: the parts between its marks in reading order."""
    p, s, m = marks

    def parts(one: str, two: str, three: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(one) + 1))
        first = F.substring_index(body, two, 1)
        rest = F.substr(body, F.char_length(first) + len(two) + 1)
        second = F.substring_index(rest, three, 1)
        return first, second, F.substr(rest, F.char_length(second) + len(three) + 1)

    prefix, suffix, middle = parts(p, s, m)
    suffix2, prefix2, middle2 = parts(s, p, m)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix2, middle2, suffix2))
        .otherwise(output)
    )
