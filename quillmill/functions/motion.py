"""Column functions for motion: 32-bit hashes, clamps, frames, rectangles, path ids, exposure steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, so that expressions that name it several times stay small."""
    return F.get(F.transform(F.array(value), use), 0)


def mul32(a: Column, b: int) -> Column:
    """The low 32 bits of a product, in two halves so that 64 bits are enough."""
    low = lambda x: x * F.lit(b & 0xFFFF) + F.shiftleft((x * F.lit(b >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return let(a, lambda x: low(x).bitwiseAND(F.lit(MASK)))


def times32(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two unsigned 32-bit columns."""
    whole = lambda x, y: x * y.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((x * F.shiftrightunsigned(y, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return let(a, lambda x: let(b, lambda y: whole(x, y).bitwiseAND(F.lit(MASK))))


def _mixed(value: Column, shift: int) -> Column:
    return let(value, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, shift)))


def uniform(seed: Column, n: Column) -> Column:
    """The ``n``-th draw (from 1) of a seeded 32-bit generator, from 0 to 1, without the draws before it. The constants are fixed values."""
    first = lambda a: times32(_mixed(a, 15), a.bitwiseOR(F.lit(1)))
    second = lambda r: (r + times32(_mixed(r, 7), r.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)).bitwiseXOR(r)
    start = (seed.cast("long") + mul32(n.cast("long"), 0x6D2B79F5)).bitwiseAND(F.lit(MASK))
    return _mixed(let(let(start, first), second), 14) / F.lit(float(1 << 32))


def name_seed(name: Column) -> Column:
    """FNV-1a over code points, as an unsigned 32-bit number."""
    return F.aggregate(
        F.filter(F.split(F.coalesce(name, F.lit("")), ""), lambda c: c != ""),
        F.lit(2166136261).cast("long"),
        lambda h, c: mul32(h.bitwiseXOR(F.ascii(c).cast("long")), 16777619),
    )


def lattice_hash(x: Column, y: Column, seed: Column) -> Column:
    """A 32-bit hash of a lattice point. The constants are fixed values."""
    u = lambda c: c.cast("long").bitwiseAND(F.lit(MASK))
    h = u(seed).bitwiseXOR(mul32(u(x), 0x27D4EB2D)).bitwiseXOR(mul32(u(y), 0x165667B1))
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h = mul32(_mixed(h, shift), factor)
    return _mixed(h, 15)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def lerp(a: Column, b: Column, k: Column) -> Column:
    return a + (b - a) * k


def smooth(x: Column, a: float, b: float) -> Column:
    k = clamp((x - a) / (b - a))
    return k * k * (3 - 2 * k)


def quantised(t: Column, fps: float) -> Column:
    """The time of the nearest frame, halves up."""
    return F.floor(t * fps + 0.5) / fps


def looped(t: Column, length: float) -> Column:
    return F.pmod(t, F.lit(length))


def cycle(t: Column, period: float, length: float) -> Column:
    """The phase, 0 to 1, of a motion whose period is changed so that a whole number of cycles fits the length."""
    n = max(1, int(length / period + 0.5))
    return F.pmod(t, F.lit(length / n)) * n / length


def warped(t: Column, start: Column, slow: float) -> Column:
    """A time on a clock that runs ``slow`` times slower from ``start`` on."""
    return start + (t - start) / slow


def db_to_gain(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 20)


def rms(x: Column) -> Column:
    """Root mean square of a group, never 0."""
    return F.sqrt(F.avg(x * x)) + 1e-12


def pan(x: Column) -> Column:
    """Gains of the left and right channel of equal power for a place from -1 to 1."""
    angle = (x + 1) * (3.141592653589793 / 4)
    return F.struct(F.cos(angle).alias("left"), F.sin(angle).alias("right"))


def sub_times(t: Column, fps: float, pieces: int, cuts: list[float] = (), shutter: float = 0.5) -> Column:
    """Array of the times whose pictures make one blurred frame: around its own time, and never beyond a cut."""

    def one(k: Column) -> Column:
        at = t + ((k + 0.5) / pieces - 0.5) * (shutter / fps)
        for c in cuts:
            at = F.when((t < c) & (at >= c), F.lit(c - 1e-4)).when((t >= c) & (at < c), F.lit(c)).otherwise(at)
        return at

    return F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), one)


def boil(x: Column, y: Column, seed: Column, drawing: Column, amp: float = 2.3, scale: float = 70.0, drawings: int = 4) -> Column:
    """A point moved by noise that is shared by all lines and drawn anew for each of ``drawings`` drawings. The constants are fixed values."""
    field = lattice_hash(seed, F.pmod(drawing, F.lit(drawings)), F.lit(0x5EED))
    shift = lambda f, dx, dy: amp * noise(x / scale + dx, y / scale + dy, f)
    return let(field, lambda f: F.struct((x + shift(f, 0.0, 0.0)).alias("x"), (y + shift(f, 41.3, -17.9)).alias("y")))


def noise(x: Column, y: Column, seed: Column) -> Column:
    """Gradient noise of the plane, smooth, about -1 to 1. The constants are fixed values."""
    fade = lambda k: k * k * k * (k * (k * 6 - 15) + 10)

    def at(p: Column) -> Column:
        ix, iy, fx, fy = p["ix"], p["iy"], p["fx"], p["fy"]

        def corner(i: int, j: int) -> Column:
            angle = lattice_hash(ix + i, iy + j, p["seed"]) * F.lit(2 * 3.141592653589793 / 2**32)
            return let(angle, lambda a: F.cos(a) * (fx - i) + F.sin(a) * (fy - j))

        row = lambda j: let(F.struct(corner(0, j).alias("a"), corner(1, j).alias("b")), lambda c: lerp(c["a"], c["b"], fade(fx)))
        return let(F.struct(row(0).alias("a"), row(1).alias("b")), lambda c: 1.4142 * lerp(c["a"], c["b"], fade(fy)))

    point = lambda p: F.struct(F.floor(p["x"]).cast("long").alias("ix"), F.floor(p["y"]).cast("long").alias("iy"), (p["x"] - F.floor(p["x"])).alias("fx"), (p["y"] - F.floor(p["y"])).alias("fy"), p["seed"].alias("seed"))
    return let(let(F.struct(x.alias("x"), y.alias("y"), seed.alias("seed")), point), at)


def overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """The area two rectangles (x0, y0, x1, y1) share."""
    side = lambda p, q, r, s: F.greatest(F.lit(0.0), F.least(q, s) - F.greatest(p, r))
    return side(a[0], a[2], b[0], b[2]) * side(a[1], a[3], b[1], b[3])


def worst_side(box: tuple[Column, Column, Column, Column], area: tuple[Column, Column, Column, Column]) -> Column:
    """How far and at which side a rectangle leaves an area, negative inside."""
    sides = (("left", area[0] - box[0]), ("right", box[2] - area[2]), ("top", area[1] - box[1]), ("bottom", box[3] - area[3]))
    return F.array_max(F.array(*(F.struct(px.alias("px"), F.lit(-k).alias("k"), F.lit(name).alias("side")) for k, (name, px) in enumerate(sides))))


def short_id(path: Column) -> Column:
    """The end of a path from its last named part, three parts at most."""
    parts = F.split(path, ">")
    named = F.coalesce(F.array_max(F.transform(parts, lambda p, i: F.when(F.contains(p, F.lit("#")), i))), F.lit(0))
    start = F.greatest(named, F.size(parts) - 3)
    return F.array_join(F.slice(parts, start + 1, F.lit(3)), ">")


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def best_shift(a: Column, b: Column, reach: int) -> Column:
    """The shift that lays one profile on the other (edges repeated), refined by a parabola, with its residual and that of no shift."""
    n = F.size(a)
    residual = lambda s: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda t, i: t + F.abs(F.get(a, i) - F.get(b, F.least(n - 1, F.greatest(F.lit(0), i + s))))) / n
    all_ = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), residual)
    least = F.array_min(all_)
    k = F.array_position(all_, least).cast("int") - 1
    left, right = F.get(all_, k - 1), F.get(all_, k + 1)
    bend = left - 2 * least + right
    off = F.when((k > 0) & (k < 2 * reach) & (bend > 0), 0.5 * (left - right) / bend).otherwise(0.0)
    return F.struct((k - reach + off).alias("shift"), least.alias("residual"), F.get(all_, F.lit(reach)).alias("still"))
