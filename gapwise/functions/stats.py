"""Fisher's exact test on one table, on the driver; number formats for text sinks."""

from __future__ import annotations

from math import exp, inf, lgamma


def _log_hyper(k: int, row: int, column: int, total: int) -> float:
    choose = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    return choose(row, k) + choose(total - row, column - k) - choose(total, column)


def fisher_tails(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float]:
    """(left, right, two-tailed) p-values; the two-tailed one sums all tables that are no likelier than this one.

    Terms are followed from the observed table outwards until they no longer count, so that large tables are quick.
    """
    row, column, total = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    lo, hi = max(0, row + column - total), min(row, column)
    here = _log_hyper(n11, row, column, total)
    mode = min(max((row + 1) * (column + 1) // (total + 2), lo), hi)

    def tail(start: int, stop: int, step: int) -> float:
        out = 0.0
        for k in range(start, stop, step):
            term = exp(_log_hyper(k, row, column, total))
            out += term
            if term < 1e-18 * max(out, 1e-300) and (k - mode) * step > 0:
                break
        return out

    left, right = min(1.0, tail(n11, lo - 1, -1)), min(1.0, tail(n11, hi + 1, 1))
    two = 0.0
    for k in _as_likely(here, mode, lo, hi, row, column, total):
        two += tail(k[0], k[1], k[2])
    return left, right, min(1.0, two)


def _as_likely(here: float, mode: int, lo: int, hi: int, row: int, column: int, total: int):
    """Both tails' ranges of tables that are no likelier than the observed one (the terms fall away from the mode)."""
    limit = here + 1e-7
    if _log_hyper(mode, row, column, total) <= limit:
        yield mode, hi + 1, 1
        yield mode - 1, lo - 1, -1
        return
    for end, step in ((hi, 1), (lo, -1)):
        a, b = mode, end + step
        while abs(b - a) > 1:  # a is likelier, b is not, or is past the end
            mid = (a + b) // 2
            a, b = (mid, b) if _log_hyper(mid, row, column, total) > limit else (a, mid)
        yield b, end + step, step


def fisher_row(n11: int, n_a: int, n_b: int, bases_a: int, bases_b: int, genome: int) -> dict[str, float]:
    """The test's row for n11 overlapping pairs of two sets; the universe is as many places as fit, at their mean lengths."""
    n12, n21 = max(0, n_a - n11), max(0, n_b - n11)
    means = 2 + (bases_a / n_a if n_a else 0) + (bases_b / n_b if n_b else 0)
    n22 = max(n11 + n12 + n21, int(genome / means)) - n11 - n12 - n21
    left, right, two = fisher_tails(n11, n12, n21, n22)
    ratio = inf if not n12 or not n21 else (n11 * n22) / (n12 * n21)
    return {"n11": n11, "n12": n12, "n21": n21, "n22": n22, "left": left, "right": right, "two_tail": two, "ratio": ratio}


def g(value: float | None, digits: int, missing: str = ".") -> str:
    """C's %.<digits>g."""
    return missing if value is None else f"{value:.{digits}g}"


def stripped(value: float, decimals: int = 6) -> str:
    """Fixed decimals without the zeros at the end."""
    return f"{value:.{decimals}f}".rstrip("0").rstrip(".")
