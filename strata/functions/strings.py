"""String helpers with explicit NULL and position semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat_skip_null(*cols) -> Column:
    """Concatenate, treating NULL as empty (all NULL -> '')."""
    return F.concat_ws("", *[_c(c) for c in cols])


def substring_neg(s, pos, length) -> Column:
    """1-based substring where a negative ``length`` takes the ``-length``
    characters *before* ``pos`` (clipped at the start of the string).

    For ``length >= 0`` it is plain ``substring``; ``pos`` must be >= 1.
    """
    s, pos, length = _c(s), _c(pos), _c(length)
    neg_start = F.greatest(F.lit(1), pos + length)
    neg_len = F.least(-length, pos - 1)
    return F.when(length < 0, s.substr(neg_start, neg_len)).otherwise(s.substr(pos, length))


def mask_except(s, keep: str, mark: str) -> Column:
    """Replace every character other than ``keep`` by ``mark``."""
    return F.regexp_replace(_c(s), f"[^{keep}]", mark)


def mask_chars(s, chars: str, mark: str) -> Column:
    """Replace each character of ``chars`` by ``mark`` (one pass, no regex)."""
    return F.translate(_c(s), chars, mark * len(chars))


def html_escape(s) -> Column:
    c = _c(s)
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))
