"""Array shaping for aligned token/label lists.

All are native higher-order-function expressions: row-local, codegen'd, no
shuffle.  Positions are 0-based in names and results, 1-based only inside
Spark's ``slice``/``element_at``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_index_of(arr, value) -> Column:
    """0-based index of the last occurrence of ``value`` (-1 if absent)."""
    a = _c(arr)
    return F.coalesce(F.array_max(F.filter(F.transform(a, lambda x, i: F.when(x == value, i)),
                                           lambda i: i.isNotNull())), F.lit(-1))


def crop_after_last(arr, marker_arr, marker: str) -> Column:
    """P5: keep elements after the last ``marker`` in ``marker_arr``.

    ``words[-ind:]`` keeps everything when the marker is absent *or* last (Q10).
    """
    a, m = _c(arr), _c(marker_arr)
    last = last_index_of(m, marker)
    keep_from = F.when((last < 0) | (last == F.size(m) - 1), F.lit(0)).otherwise(last + 1)
    return F.slice(a, keep_from + 1, F.greatest(F.size(a) - keep_from, F.lit(0)))


def drop_where(arr, key_arr, banned: tuple[str, ...]) -> Column:
    """Drop positions whose key token is one of ``banned`` (applied to aligned lists)."""
    kept = F.zip_with(_c(arr), _c(key_arr), lambda x, k: F.struct(x.alias("x"), (~k.isin(*banned)).alias("keep")))
    return F.transform(F.filter(kept, lambda e: e["keep"]), lambda e: e["x"])


def strip_pad_and_specials(tags, mask) -> Column:
    """``tags[1 : first_pad - 1]`` where first_pad is the first 0 in the mask.

    NULL when the mask has no 0 (the reference raises there).
    """
    t, m = _c(tags), _c(mask)
    pad = F.array_position(m, 0) - 1          # 0-based first pad, -1 if none
    # Python's t[1:pad-1]: pad == 0 means t[1:-1]
    return (F.when(pad == 0, F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))))
            .when(pad > 0, F.slice(t, 2, F.greatest(pad - 2, F.lit(0)))))


def tail_truncate(arr, n: int) -> Column:
    """Keep the last ``n`` elements."""
    a = _c(arr)
    return F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)


def pad_to_length(arr, n: int, pad=0) -> Column:
    """Right-pad with ``pad`` to length ``n`` (longer input unchanged)."""
    a = _c(arr)
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def head_crop(arr, n: int) -> Column:
    """P10: first ``n`` elements."""
    return F.slice(_c(arr), 1, n)


def argmax(arr) -> Column:
    """0-based index of the maximum (first on ties)."""
    a = _c(arr)
    return F.array_position(a, F.array_max(a)) - 1


def first_run(labels) -> tuple[Column, Column]:
    """(start, end) of the first run of 1s, end inclusive; (0, 0) when there is no 1."""
    a = _c(labels)
    start = F.array_position(a, 1) - 1
    z = F.array_position(F.slice(a, F.greatest(start, F.lit(0)) + 1, F.size(a)), 0)  # 1-based, 0 = none
    end = F.when(start < 0, F.lit(0)).when(z == 0, F.size(a) - 1).otherwise(start + z - 2)
    return F.greatest(start, F.lit(0)), end


def elementwise_or(arrays) -> Column:
    """OR (max) of equally long 0/1 vectors given as an array of arrays."""
    a = _c(arrays)
    return F.aggregate(a, F.try_element_at(a, F.lit(1)),
                       lambda acc, v: F.zip_with(acc, v, lambda x, y: F.greatest(x, y)))


def ids_to_tokens(ids, vocab: Column) -> Column:
    """id array -> token array through a vocabulary array (0-based ids)."""
    return F.transform(_c(ids), lambda i: F.try_element_at(vocab, (i + 1).cast("int")))


def truncate_triple(a_len, b_len, h_len, budget) -> tuple[Column, Column, Column]:
    """F19 closed form of the pop loop: history first, then the longer of a/b (tie pops b).

    Returns the kept lengths (a, b, history) for a token budget ``budget``
    (``max_len - 4`` in the reference).
    """
    a, b, h, m = _c(a_len), _c(b_len), _c(h_len), _c(budget)
    h2 = F.greatest(F.lit(0), F.least(h, m - a - b))
    x = F.greatest(F.lit(0), a + b - m)
    gap = F.least(x, F.abs(a - b))
    a1 = F.when(a > b, a - gap).otherwise(a)
    b1 = F.when(b >= a, b - gap).otherwise(b)
    rest = x - gap
    b2 = b1 - F.ceil(rest / 2).cast("int")
    a2 = a1 - F.floor(rest / 2).cast("int")
    return a2, b2, h2
