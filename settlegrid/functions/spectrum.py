"""Band power without a spectrum per row.

Band areas need only the bins around the band edges, and the total area follows
from Parseval's identity, so one hash aggregate with a handful of
``sum(x * cos)`` terms replaces a DFT join: no row is multiplied by frequencies.
Expressions are SQL text, one parsed expression each.
"""
import math

from pyspark.sql import Column, functions as F

# Band edges in cycles per hour, and samples per hour.
BANDS = {"power_6_8h": (1 / 8, 1 / 6), "power_20_28h": (1 / 28, 1 / 20)}
RATE = 2.0
DAY_SIZES = (46, 48, 50)


def needed_bins(n: int, bands=BANDS) -> list:
    step, bins = RATE / n, set()
    for low, high in bands.values():
        bins.update(range(max(0, math.floor(low / step - 1e-9)), min(n // 2, math.ceil(high / step + 1e-9)) + 1))
    return sorted(bins | {0, n // 2})


def _moment_text(x, idx, n, bins) -> dict:
    w = f"(0.5D - 0.5D * cos(2 * pi() * {idx} / {n}))"
    out = {"sx": f"sum({x})", "sxx": f"sum({x} * {x} * {w} * {w})", "sxw": f"sum({x} * {w} * {w})"}
    for k in bins:
        angle = f"2 * pi() * {k} * {idx} / {n}"
        out[f"c{k}"] = f"sum({x} * {w} * cos({angle}))"
        out[f"s{k}"] = f"sum({x} * {w} * sin({angle}))"
    return out


def moments(x: str, idx: str, n: int) -> list:
    """Aggregates over one segment of ``n`` samples of column ``x`` with index column ``idx``."""
    return [F.expr(t).alias(k) for k, t in _moment_text(x, idx, n, needed_bins(n)).items()]


def day_moments(x: str, idx: str, size: str, sizes=DAY_SIZES) -> list:
    """The same over one local day, whose length column ``size`` varies with the clock changes."""
    bins = sorted({k for n in sizes for k in needed_bins(n) if k != n // 2})
    text = _moment_text(x, idx, size, bins)
    text["c_top"] = f"sum({x} * (0.5D - 0.5D * cos(2 * pi() * {idx} / {size})) * cos(pi() * {idx}))"
    return [F.expr(t).alias(k) for k, t in text.items()]


def _window_sums(n):
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)]
    tr = {k: (sum(w[i] * math.cos(2 * math.pi * k * i / n) for i in range(n)),
              sum(w[i] * math.sin(2 * math.pi * k * i / n) for i in range(n))) for k in needed_bins(n)}
    return sum(v * v for v in w), tr


def _density_text(n: int, top=None) -> tuple:
    """({bin: one-sided density}, total area) as text over the moment columns."""
    w2, transforms = _window_sums(n)
    dens = {}
    for k, (wc, ws) in transforms.items():
        re = f"({top if top and k == n // 2 else f'c{k}'} - sx / {n} * ({wc!r}D))"
        im = "0D" if top and k == n // 2 else f"(s{k} - sx / {n} * ({ws!r}D))"
        side = 1.0 if k in (0, n // 2) else 2.0
        dens[k] = f"({side / (RATE * w2)!r}D * ({re} * {re} + {im} * {im}))"
    energy = f"((sxx - 2 * (sx / {n}) * sxw + (sx / {n}) * (sx / {n}) * {w2!r}D) / {w2!r}D)"
    return dens, f"greatest(0D, {energy} - ({dens[0]} + {dens[n // 2]}) * {RATE / n / 2!r}D)"


def _area_text(dens: dict, n: int, low: float, high: float) -> str:
    """Trapezoid area of the density between interpolated band edges."""
    step = RATE / n

    def at(f):
        k = f / step
        lo = min(max(math.floor(k + 1e-9), 0), n // 2)
        frac = k - lo
        return dens[lo] if frac < 1e-9 else f"({dens[lo]} * {1 - frac!r}D + {dens[lo + 1]} * {frac!r}D)"
    inner = [k for k in range(n // 2 + 1) if low + 1e-12 < k * step < high - 1e-12]
    xs = [low, *[k * step for k in inner], high]
    ys = [at(low), *[dens[k] for k in inner], at(high)]
    return "(" + " + ".join(f"{(xs[i + 1] - xs[i]) / 2!r}D * ({ys[i]} + {ys[i + 1]})" for i in range(len(xs) - 1)) + ")"


def densities(n: int) -> dict:
    """Columns p<k> (one-sided density at each needed bin) and total_power from :func:`moments`."""
    dens, total = _density_text(n)
    return {"total_power": F.expr(total), **{f"p{k}": F.expr(t) for k, t in dens.items()}}


def band_area(n: int, low: float, high: float) -> Column:
    """Band area from the density columns p<k>."""
    return F.expr(_area_text({k: f"p{k}" for k in needed_bins(n)}, n, low, high))


def day_fractions(size: str, sizes=DAY_SIZES, bands=BANDS) -> dict:
    """Band share of the total area for each possible day length, from :func:`day_moments`."""
    text = {name: "CASE" for name in bands}
    for n in sizes:
        dens, total = _density_text(n, top="c_top")
        # A flat day leaves rounding noise only; it has no spectrum.
        flat = f"{total} <= 1e-18D * greatest(1D, abs(sxx))"
        for name, (low, high) in bands.items():
            text[name] += f" WHEN {size} = {n} THEN CASE WHEN {flat} THEN 0D ELSE {_area_text(dens, n, low, high)} / {total} END"
    return {name: F.expr(t + " END") for name, t in text.items()}
