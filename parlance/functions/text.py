"""Text functions as native Spark expressions.

Everything here returns a ``Column`` so it stays inside whole-stage codegen;
no Python runs per row.

Regex flavour: Python's ``\\w`` is Unicode, Java's is ASCII and DuckDB uses
RE2, so the word class is spelt out as ``[\\p{L}\\p{N}_]`` and the whitespace
that ``str.strip()`` removes is listed explicitly.  The token pattern yields
the word runs and the *stripped* non-word runs of ``re.split('(\\W+)')``
directly, so no trim/filter pass is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes matching Python's str semantics.
WORD_CLASS = r"\p{L}\p{N}_"
STRIP_WS_CLASS = (r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}"
                  r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
TOKEN_PATTERN = (f"[{WORD_CLASS}]+"
                 f"|[^{WORD_CLASS}{STRIP_WS_CLASS}](?:[^{WORD_CLASS}]*[^{WORD_CLASS}{STRIP_WS_CLASS}])?")
# Byte-level BPE space marker.
BPE_SPACE = "Ġ"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_tokens(text) -> Column:
    """``[t.strip() for t in re.split('(\\W+)', text) if t.strip()]`` as array<string>."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)


def detok_byte_bpe(text) -> Column:
    """if the BPE space marker occurs, drop spaces and turn the marker into a space."""
    t = _c(text)
    return F.when(t.contains(BPE_SPACE),
                  F.trim(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit(BPE_SPACE), F.lit(" ")))
                  ).otherwise(t)


def tokenize_str(text) -> Column:
    """Scorer tokenisation: F2 then F1, tokens joined by one space."""
    return F.array_join(word_tokens(detok_byte_bpe(text)), " ")


# Lambdas below never reference an outer array: the optimizer may inline a
# computed array column into a lambda body, re-evaluating it per element.  The
# arrays travel in the fold accumulator instead (evaluated once per row).

def _window_hits(hay, needle, first_only: bool) -> Column:
    """Start offsets where ``needle`` occurs contiguously in ``hay`` (fold, O(n*m))."""
    h, n = _c(hay), _c(needle)
    init = F.struct(h.alias("h"), n.alias("n"), F.array().cast("array<int>").alias("hits"))

    def step(acc, i):
        m = F.size(acc["n"])
        hit = F.slice(acc["h"], i + 1, m) == acc["n"]
        if first_only:
            hit = hit & (F.size(acc["hits"]) == 0)
        return F.struct(acc["h"], acc["n"],
                        F.when(hit, F.concat(acc["hits"], F.array(i))).otherwise(acc["hits"]).alias("hits"))

    span = F.size(h) - F.size(n)
    return F.when(span >= 0,
                  F.aggregate(F.sequence(F.lit(0), F.greatest(span, F.lit(0))), init, step,
                              lambda acc: acc["hits"])
                  ).otherwise(F.array().cast("array<int>"))


def contains_window(hay, needle) -> Column:
    """``needle`` (array) occurs contiguously in ``hay`` (array); empty needle is true."""
    return F.size(_window_hits(hay, needle, first_only=True)) > 0


def is_in_list(tok, value) -> Column:
    """J8 on strings: tokens of ``value`` occur contiguously in tokens of ``tok``."""
    return contains_window(word_tokens(tok), word_tokens(value))


def token_positions(tokens, value_tokens) -> Column:
    """all (start, exclusive_end) where ``value_tokens`` occurs in ``tokens``."""
    v = _c(value_tokens)
    starts = _window_hits(tokens, v, first_only=False)
    return F.zip_with(starts, F.array_repeat(F.size(v), F.size(starts)),
                      lambda s, m: F.struct(s.alias("start"), (s + m).alias("end")))


def span_labels(n_tokens, start, end) -> Column:
    """0/1 vector of length n with ones on [start, end)."""
    n = _c(n_tokens)
    ones = F.greatest(F.least(_c(end), n) - F.greatest(_c(start), F.lit(0)), F.lit(0))
    lead = F.least(F.greatest(_c(start), F.lit(0)), n)
    return F.concat(F.array_repeat(F.lit(0), lead), F.array_repeat(F.lit(1), ones),
                    F.array_repeat(F.lit(0), F.greatest(n - lead - ones, F.lit(0))))


def undo_wordpiece(tokens, start, end) -> Column:
    """join tokens[start..end] (inclusive) and glue ``##`` pieces."""
    joined = F.array_join(F.slice(_c(tokens), _c(start) + 1, _c(end) - _c(start) + 1), " ")
    return F.regexp_replace(F.regexp_replace(joined, r" ##", ""), r"^##", "")
