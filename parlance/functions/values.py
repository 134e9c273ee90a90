"""Value matching against utterances (F8, F10, F11, F13, F16, D6 helpers).

Folds carry their arrays in the accumulator (see ``text.py``) so nothing is
re-evaluated per element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import variants_of
from .text import STRIP_WS_CLASS, _window_hits, contains_window, word_tokens

UNK = "[UNK]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _pos_structs(starts: Column, m: Column) -> Column:
    return F.zip_with(starts, F.array_repeat(m, F.size(starts)),
                      lambda s, k: F.struct(s.alias("start"), (s + k).alias("end")))


def label_existence(tokens, value, maps: Column) -> Column:
    """F8: struct(found, positions) of ``value`` in ``tokens``, else of the first label-map variant that hits."""
    toks, v = _c(tokens), _c(value)
    vt = word_tokens(v)
    own = _window_hits(toks, vt, first_only=False)
    init = F.struct(toks.alias("t"), F.size(own).alias("n"), _pos_structs(own, F.size(vt)).alias("pos"))

    def step(acc, variant):
        vv = word_tokens(variant)
        hits = _window_hits(acc["t"], vv, first_only=False)
        return F.when(acc["n"] > 0, acc).otherwise(
            F.struct(acc["t"], F.size(hits).alias("n"), _pos_structs(hits, F.size(vv)).alias("pos")))

    variants = F.coalesce(variants_of(maps, v), F.array().cast("array<string>"))
    res = F.aggregate(variants, init, step)
    return F.struct((res["n"] > 0).alias("found"), res["pos"].alias("positions"))


def _loose_match(a: Column, a_toks: Column, b: Column, b_toks: Column) -> Column:
    return (a == b) | contains_window(b_toks, a_toks) | contains_window(a_toks, b_toks)


def any_variant_matches(variants: Column, other: Column, other_toks: Column) -> Column:
    """Some variant equals / contains / is contained in ``other`` (tokens carried in the accumulator)."""
    init = F.struct(other.alias("o"), other_toks.alias("ot"), F.lit(False).alias("hit"))
    res = F.aggregate(F.coalesce(variants, F.array().cast("array<string>")), init,
                      lambda acc, x: F.struct(acc["o"], acc["ot"],
                                              (acc["hit"] | _loose_match(x, word_tokens(x), acc["o"], acc["ot"]))
                                              .alias("hit")))
    return res["hit"]


def inform_match(value, informed, maps: Column) -> Column:
    """F10 core: does the (normalised) value match one informed value (equal, containment, variants)."""
    vl, il = _c(value), _c(informed)
    vt, it = word_tokens(vl), word_tokens(il)
    il_vars = variants_of(maps, il)
    vl_vars = variants_of(maps, vl)
    return (_loose_match(vl, vt, il, it)
            | F.when(il_vars.isNotNull(), any_variant_matches(il_vars, vl, vt))
            .otherwise(any_variant_matches(vl_vars, il, it)))


def first_informed(value, informed_list, maps: Column) -> Column:
    """struct(found, value) -- the first informed value that matches, else 'none'."""
    init = F.struct(_c(value).alias("v"), F.lit(None).cast("string").alias("hit"))
    res = F.aggregate(F.coalesce(_c(informed_list), F.array().cast("array<string>")), init,
                      lambda acc, il: F.when(acc["hit"].isNotNull(), acc).otherwise(
                          F.struct(acc["v"], F.when(inform_match(acc["v"], il, maps), il).alias("hit"))))
    return F.struct(res["hit"].isNotNull().alias("found"), F.coalesce(res["hit"], F.lit("none")).alias("value"))


def delex(tokens, values, compat_letters: bool = False) -> Column:
    """replace every occurrence of each value's tokens by ``[UNK]`` (in place, values in order).

    With ``compat_letters`` a value given as the bare string 'none' is iterated as
    its letters like the reference does when a turn has no act (Q9).
    """
    t, vals = _c(tokens), _c(values)
    if compat_letters:
        vals = F.flatten(F.transform(vals, lambda v: F.when(v == "none", F.array(
            F.lit("n"), F.lit("o"), F.lit("n"), F.lit("e"))).otherwise(F.array(v))))

    def one_value(arr: Column, v: Column) -> Column:
        vt = word_tokens(v)
        init = F.struct(arr.alias("a"), vt.alias("v"))

        def step(acc, i):
            m = F.size(acc["v"])
            hit = F.slice(acc["a"], i + 1, m) == acc["v"]
            replaced = F.concat(F.slice(acc["a"], 1, i), F.array_repeat(F.lit(UNK), m),
                                F.slice(acc["a"], i + m + 1, F.greatest(F.size(acc["a"]) - i - m, F.lit(0))))
            return F.struct(F.when(hit, replaced).otherwise(acc["a"]).alias("a"), acc["v"])

        span = F.size(arr) - F.size(vt)
        return F.when((v == "none") | (span < 0) | (F.size(vt) == 0), arr).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.greatest(span, F.lit(0))), init, step, lambda acc: acc["a"]))

    return F.aggregate(vals, t, lambda acc, v: one_value(acc, v))


def state_dict(entries) -> Column:
    """F16: array<struct<slot,value>> -> map, the last entry of a slot wins."""
    init = F.struct(F.array().cast("array<string>").alias("k"), F.array().cast("array<string>").alias("v"))

    def step(acc, e):
        pos = F.array_position(acc["k"], e["slot"])
        return F.when(pos > 0, F.struct(acc["k"], F.transform(acc["v"], lambda x, i: F.when(
            i == pos - 1, e["value"]).otherwise(x)).alias("v"))).otherwise(
            F.struct(F.concat(acc["k"], F.array(e["slot"])).alias("k"),
                     F.concat(acc["v"], F.array(e["value"])).alias("v")))

    return F.aggregate(_c(entries), init, step, lambda acc: F.map_from_arrays(acc["k"], acc["v"]))


def split_words(text) -> Column:
    """``str.split()``: runs of non-whitespace."""
    return F.regexp_extract_all(_c(text), F.lit(f"[^{STRIP_WS_CLASS}]+"), 0)


def span_words_to_slot(text, labels) -> Column:
    """word -> slot for the words inside each label's char span; later labels win.

    ``startIndex`` defaults to 0 and ``endIndex`` to -1 (the last character is
    lost, Q11); Python slice semantics for negative ends.
    """
    t = _c(text)
    n = F.length(t)

    def words_of(lab):
        s = F.coalesce(lab["valueSpan"]["startIndex"], F.lit(0))
        e = F.coalesce(lab["valueSpan"]["endIndex"], F.lit(-1))
        s2 = F.when(s < 0, F.greatest(n + s, F.lit(0))).otherwise(F.least(s, n))
        e2 = F.when(e < 0, F.greatest(n + e, F.lit(0))).otherwise(F.least(e, n))
        piece = F.when(e2 > s2, F.substring(t, s2 + 1, e2 - s2)).otherwise(F.lit(""))
        return F.transform(split_words(piece), lambda w: F.struct(w.alias("slot"), lab["slot"].alias("value")))

    entries = F.flatten(F.transform(F.coalesce(_c(labels), F.array().cast(
        "array<struct<slot:string,valueSpan:struct<startIndex:int,endIndex:int>>>")), words_of))
    return state_dict(entries)
