"""Full-text search: query parsing, folded and stemmed terms, phrases, and BM25.

Texts and queries go through one tokenizer: letters and digits are tokens, case and the diacritics of Latin letters
are folded in the JVM, and tokens are reduced to Porter stems (in Arrow batches). ``match`` searches by a scan of the posts
at hand; the stored inverted index is in ``postings``.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.porter import stem

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
K1, B = 1.2, 0.75
#: Replaces an inverse document frequency that isn't positive.
LEAST_IDF = 1e-6


class QueryError(ValueError):
    """The query can't be parsed; shown to the user instead of an empty result."""


Clauses = list[list[str]]
_PIECES = re.compile(r'"(?P<phrase>[^"]*)"|(?P<open>")|(?P<bare>[^"]+)')


def parse(query: str) -> Clauses:
    """Quoted phrases first, then bare terms, all to be matched; each is a list of tokens.

    AND, OR and NOT are ordinary words. A clause that has no token (such as a lone underscore) stays
    in the list, empty, and matches nothing.
    """
    phrases, bare = [], []
    for piece in _PIECES.finditer(query):
        if piece["open"]:
            raise QueryError("a quotation mark is left open")
        words = re.findall(r"\w+", piece["phrase"] or piece["bare"] or "")
        if piece["bare"]:
            bare += words
        elif words:
            phrases.append(" ".join(words))
    if not phrases and not bare:
        raise QueryError("nothing to search for")
    return [tokens(c) for c in phrases + bare]


def tokens(text: str) -> list[str]:
    """Tokens of a short text on the driver, before folding."""
    return re.findall(r"[^\W_]+", text.lower())


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """(letters, what each becomes), for ``translate``; letters beyond the second text's length go.

    Rule: a letter becomes its simple case folding, and a Latin letter that Unicode decomposes into a letter from a to
    z and one mark becomes that letter; these marks themselves (up to U+0331) go.
    """
    change, marks = {}, set()
    for code in [*range(0x80, 0x3000), *range(0xA640, 0xAC00), *range(0xFF21, 0xFF5B)]:
        letter = chr(code)
        folded = letter.casefold() if len(letter.casefold()) == 1 else letter.lower() if len(letter.lower()) == 1 else letter
        parts = unicodedata.decomposition(folded).split()
        if len(parts) == 2 and parts[0][0] != "<" and "a" <= chr(int(parts[0], 16)) <= "z":
            folded = chr(int(parts[0], 16))
            marks |= {int(parts[1], 16)} if int(parts[1], 16) <= 0x331 else set()
        if folded != letter:
            change[letter] = folded
    return "".join(change) + "".join(map(chr, sorted(marks))), "".join(change.values())


def fold(text: str) -> str:
    """A text on the driver, folded as ``folded`` does it."""
    source, target = folding()
    table = {ord(c): target[i] if i < len(target) else None for i, c in enumerate(source)}
    return text.translate(table).lower().translate(table)


def folded(text: Column) -> Column:
    source, target = folding()
    return F.translate(F.lower(text), source, target)


def token_column(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


#: Texts whose tokens are Python objects at a time.
SLICE = 256


def stems_of(words: pa.Array) -> pa.Array:
    """Porter stems of tokens; each different one is stemmed once."""
    known = words.dictionary_encode()
    return pa.array([stem(w) for w in known.dictionary.to_pylist()], pa.string()).take(known.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(words: pa.Array) -> pa.Array:
    """Porter stems of arrays of tokens; no token but a slice's different ones becomes a Python object."""
    out = []
    for start in range(0, len(words), SLICE):
        rows = words.slice(start, SLICE)
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        out.append(pa.ListArray.from_arrays(ends, stems_of(rows.flatten()), mask=rows.is_null()))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def words_of(text: Column, stems: bool = True) -> Column:
    return stemmed(token_column(text)) if stems else token_column(text)


def normal(clauses: Clauses, stems: bool = True) -> Clauses:
    """The clauses as they stand in an index."""
    return [[stem(fold(t)) if stems else fold(t) for t in c] for c in clauses]


def spaced(words: Column) -> Column:
    """Tokens as one text with a space before and after each."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def occurrences(line: Column, clause: list[str]) -> Column:
    """How often the clause stands in a spaced line, as a phrase of adjacent tokens; overlaps count."""
    if not clause:
        return F.lit(0)
    after = "".join(f" {t}" for t in clause[1:])
    return F.regexp_count(line, F.lit(f"(?<= ){clause[0]}(?={after} )"))


def match(posts: DataFrame, clauses: Clauses, stems: bool = True) -> DataFrame:
    """(canonical_id, bm25) of the posts that hold every clause; lower is better.

    The statistics are those of all posts given, not only of the eligible ones.
    """
    clauses = normal(clauses, stems)
    words = posts.select("canonical_id", words_of(F.coalesce("text", F.lit("")), stems).alias("words"))
    lines = words.select("canonical_id", spaced(F.col("words")).alias("line"), F.size("words").alias("n"))
    counted = lines.select("canonical_id", "n", *[occurrences(F.col("line"), c).alias(f"f{i}") for i, c in enumerate(clauses)])
    stats = counted.agg(
        F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(clauses))]
    )
    hits = counted.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(clauses))]))
    return hits.crossJoin(F.broadcast(stats)).select("canonical_id", score(len(clauses)).alias("bm25"))  # stats: one row


def score(clauses: int) -> Column:
    """-sum of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * n / mean))."""
    total = F.lit(0.0)
    for i in range(clauses):
        f, d = F.col(f"f{i}").cast("double"), F.col(f"d{i}")
        idf = F.ln((F.col("docs") - d + 0.5) / (d + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return -total
