"""Array mathematics on array<double> columns: element-wise, reductions, norms, ordering, products and quantization."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks.functions.strings import let

UNARY: dict[str, Callable[[Column], Column]] = {
    "sigmoid": lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)),
    "tanh": F.tanh,
    "exp": F.exp,
    "sin": F.sin,
    "cos": F.cos,
    "neg": F.negative,
    "abs": F.abs,
    "log": F.ln,
    "sqrt": F.sqrt,
    "rsqrt": lambda x: F.lit(1.0) / F.sqrt(x),
    "square": lambda x: x * x,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "silu": lambda x: x / (F.lit(1.0) + F.exp(-x)),
    "erf": lambda x: erf(x),
    "gelu": lambda x: x * F.lit(0.5) * (F.lit(1.0) + erf(x / math.sqrt(2.0))),
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b,
    "floor_div": lambda a, b: F.floor(a / b).cast("double"),
    "power": F.pow,
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "eq": lambda a, b: a == b,
}


def erf(x: Column) -> Column:
    """The error function within 1.5e-7 (Abramowitz and Stegun 7.1.26); the engine has none."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * F.abs(x))
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def map_unary(a: Column, name: str) -> Column:
    return F.transform(a, UNARY[name])


def map_binary(a: Column, b: Column, name: str) -> Column:
    return F.zip_with(a, b, BINARY[name])


def where(cond: Column, a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(cond.alias("c"), a.alias("a"), b.alias("b")), lambda x: F.when(x["c"], x["a"]).otherwise(x["b"]))


def clip(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def logsumexp(a: Column) -> Column:
    return let(F.array_max(a), lambda top: top + F.log(total(F.transform(a, lambda x: F.exp(x - top)))))


def softmax(a: Column) -> Column:
    powers = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(total(p), lambda n: F.transform(p, lambda x: x / n)))


def rms_norm(a: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(total(F.transform(a, lambda x: x * x)) / F.size(a) + F.lit(eps))
    return let(scale, lambda n: F.transform(a, lambda x: x / n))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    def centred(m: Column) -> Column:
        spread = F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a) + F.lit(eps))
        return let(spread, lambda n: F.transform(a, lambda x: (x - m) / n))

    return let(mean(a), centred)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def matvec(rows: Column, v: Column) -> Column:
    """A matrix (array of arrays) times a vector."""
    return F.transform(rows, lambda r: dot(r, v))


def argmax(a: Column) -> Column:
    """The 0-based place of the largest value, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argsort(a: Column) -> Column:
    """0-based places in ascending order of the values, equals in order."""
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda p: p["i"])


def top_k(a: Column, k: int) -> Column:
    """array of struct(value, index) of the k largest, equals by index."""
    keyed = F.transform(a, lambda x, i: F.struct((-x).alias("k"), i.alias("index"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda p: F.struct(p["value"].alias("value"), p["index"].alias("index")))


def take(a: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(a, i))


def put(a: Column, places: Column, values: Column) -> Column:
    """a with values at the 0-based places; the first of equal places counts."""
    return F.transform(a, lambda x, i: F.coalesce(F.get(values, (F.array_position(places, i) - 1).cast("int")), x))


def reshape(a: Column, width: int) -> Column:
    """Rows of `width` values."""
    return F.transform(F.sequence(F.lit(1), F.size(a), F.lit(width)), lambda i: F.slice(a, i, F.lit(width)))


def transpose(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def pad(a: Column, before: int, after: int, value: float = 0.0) -> Column:
    return F.concat(F.array_repeat(F.lit(value), before), a, F.array_repeat(F.lit(value), after))


def affine_quantized(a: Column, bits: int, group: int) -> Column:
    """array of struct(scale, bias, q) per group: q = round((x - bias) / scale), bias the least value."""
    groups = reshape(a, group)
    levels = (1 << bits) - 1

    def one(g: Column) -> Column:
        low, high = F.array_min(g), F.array_max(g)
        scale = F.when(high > low, (high - low) / levels).otherwise(F.lit(1.0))
        return F.struct(scale.alias("scale"), low.alias("bias"), F.transform(g, lambda x: F.round((x - low) / scale).cast("int")).alias("q"))

    return F.transform(groups, one)


def affine_restored(quantized: Column) -> Column:
    return F.flatten(F.transform(quantized, lambda g: F.transform(g["q"], lambda q: g["scale"] * q + g["bias"])))


def unpacked(packed: Column, bits: int) -> Column:
    """Values of `bits` bits (4 or 8) from 32-bit words, lowest bits first."""
    per = 32 // bits
    digit = lambda w, j: (F.floor(w.cast("long") / F.pow(F.lit(2.0), j * F.lit(bits))) % F.lit(1 << bits)).cast("int")
    return F.flatten(F.transform(packed, lambda w: F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: digit(w, j))))


def conv_length(n: Column, kernel: int = 3, stride: int = 2, padding: int = 1) -> Column:
    return F.floor((n + 2 * padding - kernel) / stride).cast("int") + 1


def positions_table(length: int, channels: int) -> list[list[float]]:
    """Sinusoidal positions: sines, then cosines of scaled time."""
    half = channels // 2
    step = math.log(10000.0) / (half - 1)
    return [[math.sin(t * math.exp(-step * i)) for i in range(half)] + [math.cos(t * math.exp(-step * i)) for i in range(half)] for t in range(length)]
