"""Quantum CSS codes as edge tables: each constructor is arithmetic on ranges, so matrices of any size stay distributed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from .graph import Tanner, check_degrees, mod2, variable_degrees


@dataclass(frozen=True)
class Css:
    """X and Z check matrices over the same variables."""

    hx: Tanner
    hz: Tanner
    name: str = "code"

    def __post_init__(self):
        if not self.hx.variables == self.hz.variables != 0:
            raise ValueError("both matrices need the same, non-zero number of columns")


def edge(c: Column, v: Column) -> list[Column]:
    return [c.cast("int").alias("c"), v.cast("int").alias("v")]


def transposed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("c"), F.col("c").alias("v"))


def shifted(edges: DataFrame, columns: int = 0, rows: int = 0) -> DataFrame:
    return edges.select(*edge(F.col("c") + rows, F.col("v") + columns))


def beside(left: DataFrame, right: DataFrame, columns: int) -> DataFrame:
    """[left | right], left with so many columns."""
    return left.unionByName(shifted(right, columns))


def kron_identity(edges: DataFrame, n: int) -> DataFrame:
    """edges (x) I_n."""
    k = edges.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return k.select(*edge(F.col("c") * n + F.col("k"), F.col("v") * n + F.col("k")))


def identity_kron(n: int, edges: DataFrame, rows: int, columns: int) -> DataFrame:
    """I_n (x) edges, which have so many rows and columns."""
    k = edges.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return k.select(*edge(F.col("k") * rows + F.col("c"), F.col("k") * columns + F.col("v")))


def literals(xs: Sequence[int]) -> Column:
    return F.array(*(F.lit(int(x)) for x in xs))


def circulant(spark: SparkSession, size: int, powers: Sequence[int]) -> DataFrame:
    """Ones at ((i + p) mod size, i)."""
    x = spark.range(size).withColumn("p", F.explode(literals(powers)))
    return x.select(*edge(F.pmod(F.col("id") + F.col("p"), F.lit(size)), F.col("id"))).distinct()


def repetition(spark: SparkSession, d: int) -> Tanner:
    x = spark.range(d - 1).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return Tanner(x.select(*edge(F.col("id"), F.col("id") + F.col("k"))), d - 1, d)


def hamming(spark: SparkSession, rank: int) -> Tanner:
    """Columns are 1 to 2^rank - 1 in binary, most significant bit first."""
    x = spark.range(1, 2**rank).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(rank - 1))))
    bit = F.expr(f"getbit(id, {rank - 1} - c)")
    return Tanner(x.where(bit == 1).select(*edge(F.col("c"), F.col("id") - 1)), rank, 2**rank - 1)


def generalized_bicycle(spark: SparkSession, size: int, a: Sequence[int], b: Sequence[int]) -> Css:
    """hx = [A | B], hz = [B' | A'] of two circulants."""
    x, y = circulant(spark, size, a), circulant(spark, size, b)
    return Css(Tanner(beside(x, y, size), size, 2 * size), Tanner(beside(transposed(y), transposed(x), size), size, 2 * size), "GB")


def bicycle(spark: SparkSession, size: int, a: Sequence[int], b: Sequence[int]) -> Css:
    """As generalized_bicycle with powers of the shift by -1, summed over GF(2): equal powers cancel."""
    odd = lambda powers: [-p for p in {q % size for q in powers} if sum(r % size == p for r in powers) % 2]
    x, y = odd(a), odd(b)
    if not x or not y:
        raise ValueError("all terms cancel")
    return Css(*(lambda g: (g.hx, g.hz))(generalized_bicycle(spark, size, x, y)), "BICYCLE")


def hypergraph_product(h1: Tanner, h2: Tanner, name: str = "HP") -> Css:
    """hx = [h1 (x) I | I (x) h2'], hz = [I (x) h2 | h1' (x) I]."""
    m1, n1, m2, n2 = h1.checks, h1.variables, h2.checks, h2.variables
    hx = beside(kron_identity(h1.edges, n2), identity_kron(m1, transposed(h2.edges), n2, m2), n1 * n2)
    hz = beside(identity_kron(n1, h2.edges, m2, n2), kron_identity(transposed(h1.edges), m2), n1 * n2)
    return Css(Tanner(hx, m1 * n2, n1 * n2 + m1 * m2), Tanner(hz, n1 * m2, n1 * n2 + m1 * m2), name)


def surface(spark: SparkSession, n: int) -> Css:
    h = repetition(spark, n)
    return hypergraph_product(h, h, f"Surface_n{n * n + (n - 1) ** 2}_k1_d{n}")


def plaquettes(spark: SparkSession, rows: int, n: int, parity: int) -> DataFrame:
    """Four cells around each (i, j) of one colour on an n x n torus, i and j below `rows`; numbered row by row."""
    x = spark.range(rows * rows).select(F.floor(F.col("id") / rows).alias("i"), (F.col("id") % rows).alias("j")).where((F.col("i") + F.col("j")) % 2 == parity)
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    i, j = (F.col("i") + F.floor(F.col("k") / 2)) % n, (F.col("j") + F.col("k") % 2) % n
    return x.select(*edge(F.col("i") * (rows // 2) + F.floor(F.col("j") / 2), i * n + j))


def rotated_surface(spark: SparkSession, n: int) -> Css:
    if n % 2 == 0:
        raise ValueError("n must be odd")
    half, m = (n - 1) ** 2 // 2, (n * n - 1) // 2
    k = spark.range(n - 1).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    even = F.col("id") % 2 == 0
    top = F.when(even, 0).otherwise((n - 1) * n) + F.col("id") + F.col("s")
    side = (F.col("id") + F.col("s")) * n + F.when(even, n - 1).otherwise(0)
    hx = plaquettes(spark, n - 1, n, 1).unionByName(k.select(*edge(F.col("id") + half, top)))
    hz = plaquettes(spark, n - 1, n, 0).unionByName(k.select(*edge(F.col("id") + half, side)))
    return Css(Tanner(hx, m, n * n), Tanner(hz, m, n * n), "Rotated_Surface")


def checkerboard_toric(spark: SparkSession, n: int) -> Css:
    if n % 2:
        raise ValueError("n must be even")
    # On the 2 x 2 torus the cells of a plaquette coincide with another's, never with its own.
    return Css(Tanner(plaquettes(spark, n, n, 1), n * n // 2, n * n), Tanner(plaquettes(spark, n, n, 0), n * n // 2, n * n), "Toric")


def cyclic_permuting(n: int, shifts: Sequence[int]) -> list[list[int]]:
    """The n x n table of shifts for quasi_cyclic: a row is the one above rolled by one, and begins as shifts[0],
    no block (-1), ..., shifts[1]."""
    top = [*shifts[:1], *[-1] * (n - len(shifts)), *shifts[:0:-1]]
    return [top[n - r :] + top[: n - r] for r in range(n)]


def shift_blocks(spark: SparkSession, shifts: Sequence[Sequence[int]], size: int) -> DataFrame:
    """A block matrix of shifted identities; -1 is a block of zeros."""
    blocks = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(k).alias("k"), F.lit(int(s)).alias("s")) for r, row in enumerate(shifts) for k, s in enumerate(row) if s >= 0))
    x = spark.range(size).withColumn("b", F.explode(blocks))
    return x.select(*edge(F.col("b.r") * size + F.pmod(F.col("id") + F.col("b.s"), F.lit(size)), F.col("b.k") * size + F.col("id")))


def quasi_cyclic(spark: SparkSession, size: int, a: Sequence[Sequence[int]], b: Sequence[int]) -> Css:
    """hx = [A | I (x) B], hz = [I (x) B' | A'] of shift blocks A and a circulant B."""
    m, n = len(a), len(a[0])
    x, y = shift_blocks(spark, a, size), circulant(spark, size, b)
    hx = beside(x, identity_kron(m, y, size, size), n * size)
    hz = beside(identity_kron(n, transposed(y), size, size), transposed(x), n * size)
    return Css(Tanner(hx, m * size, (m + n) * size), Tanner(hz, n * size, (m + n) * size), "GHP")


def bivariate_terms(spark: SparkSession, size_x: int, size_y: int, x_powers: Sequence[int], y_powers: Sequence[int]) -> list[DataFrame]:
    """The monomials x^p and y^p as permutation matrices on size_x x size_y nodes, in this order."""
    i, j = F.floor(F.col("id") / size_y), F.col("id") % size_y
    n = spark.range(size_x * size_y)
    xs = [n.select(*edge(F.pmod(i - p, F.lit(size_x)) * size_y + j, F.col("id"))) for p in x_powers]
    return xs + [n.select(*edge(i * size_y + F.pmod(j - p, F.lit(size_y)), F.col("id"))) for p in y_powers]


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bivariate_bicycle(spark: SparkSession, size_x: int, size_y: int, ax: Sequence[int], ay: Sequence[int], bx: Sequence[int], by: Sequence[int]) -> tuple[Css, list[DataFrame], list[DataFrame]]:
    """hx = [A | B], hz = [B' | A'] of sums of shifts in two directions, and the terms of A (x, then y) and B (y, then x)."""
    terms_a = bivariate_terms(spark, size_x, size_y, ax, ay)
    b = bivariate_terms(spark, size_x, size_y, bx, by)
    terms_b = b[len(bx) :] + b[: len(bx)]
    n = size_x * size_y
    x, y = union(terms_a).distinct(), union(terms_b).distinct()
    code = Css(Tanner(beside(x, y, n), n, 2 * n), Tanner(beside(transposed(y), transposed(x), n), n, 2 * n), "BB")
    return code, terms_a, terms_b


def margulis(hx: Tanner, hz: Tanner, terms_a: Sequence[DataFrame], terms_b: Sequence[DataFrame]) -> tuple[Css, list[DataFrame], list[DataFrame]]:
    """A code from given matrices and terms, unchecked."""
    return Css(hx, hz, "Margulis"), list(terms_a), list(terms_b)


def multiplied(x: tuple[int, int], y: tuple[int, int], n: int, m: int, k: int) -> tuple[int, int]:
    """Product in the semidirect product of Z_n by Z_m, whose generator acts by multiplication with k."""
    return (x[0] + y[0] * pow(k, x[1], n)) % n, (x[1] + y[1]) % m


def two_block_group(spark: SparkSession, n: int, m: int, k: int, a: Sequence[tuple[int, int]], b: Sequence[tuple[int, int]], swapped: bool = False) -> Css:
    """Left multiplication by the elements of a beside right multiplication by those of b, over GF(2). `swapped`:
    elements are written in the other order of the generators."""
    plain = lambda p: [(y * pow(k, x, n) % n, x) for x, y in p] if swapped else list(p)
    size = n * m
    c, d = F.floor(F.col("id") / m), F.col("id") % m
    powers = literals([pow(k, e, n) for e in range(m)])
    left = [spark.range(size).select(*edge(F.pmod(x + c * pow(k, y, n), F.lit(n)) * m + F.pmod(d + y, F.lit(m)), F.col("id"))) for x, y in plain(a)]
    right = [spark.range(size).select(*edge(F.pmod(c + x * F.get(powers, d), F.lit(n)) * m + F.pmod(d + y, F.lit(m)), F.col("id"))) for x, y in plain(b)]
    x, y = mod2(union(left)), mod2(union(right))
    return Css(Tanner(beside(x, y, size), size, 2 * size), Tanner(beside(transposed(y), transposed(x), size), size, 2 * size), "2BGA")


def cycle_assemble(spark: SparkSession, p: int, sigma: int) -> Css:
    """Shift blocks -sigma^j, rolled row by row, after a column of shifts -1 and before a column of ones."""
    first = [pow(sigma, j, p) for j in range(p - 1)]
    shifts = [[-s % p for s in (1, *(first[(j - i) % (p - 1)] for j in range(p - 1)))] for i in range(p - 1)]
    half = (p - 1) // 2

    def part(rows: list[list[int]]) -> Tanner:
        ones = spark.range(half * p).select(*edge(F.col("id"), F.lit(p * p)))
        return Tanner(shift_blocks(spark, rows, p).unionByName(ones), half * p, p * p + 1)

    return Css(part(shifts[:half]), part(shifts[half:]), "CAMEL")


def euclidean_geometry(spark: SparkSession, s: int) -> Css:
    """Points and lines of the plane over GF(2^s), and a column of ones; both matrices are alike.

    A line through alpha^i in direction alpha^j holds alpha^i + beta^k alpha^j; point 0 is zero, i + 1 is alpha^i.
    """
    order, step = 2 ** (2 * s) - 1, 2**s + 1
    log, antilog = fields.tables(2 * s, fields.primitive_polynomial(2 * s))
    logs, powers = literals(log), literals(antilog)
    x = spark.range(order * step).select(F.floor(F.col("id") / step).cast("int").alias("i"), (F.col("id") % step).cast("int").alias("j"))
    other = lambda k: F.get(logs, F.get(powers, F.col("i")).bitwiseXOR(F.get(powers, ((k * step + F.col("j")) % order).cast("int")))) + 1
    points = F.array_sort(F.array_distinct(F.concat(F.array(F.col("i") + 1), F.transform(F.sequence(F.lit(0), F.lit(2**s - 2)), other))))
    # Columns in order of their incidence vectors, which is their order as strings of bits.
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(order)), lambda q: F.when(F.array_contains("points", q), "1").otherwise("0")), "")
    from pyspark.sql import Window

    lines = x.select(points.alias("points")).distinct().withColumn("bits", bits).withColumn("v", F.row_number().over(Window.orderBy("bits")) - 1)
    n = 2 ** (2 * s) + 2**s
    h = lines.select(F.explode("points").alias("c"), "v").select(*edge(F.col("c"), F.col("v"))).unionByName(spark.range(order + 1).select(*edge(F.col("id"), F.lit(n))))
    return Css(Tanner(h, order + 1, n + 1), Tanner(h, order + 1, n + 1), "EG")


#: size_x, size_y, powers of x and y in A, of x and y in B, rounds.
PRESETS = {
    "72": (6, 6, (3,), (1, 2), (1, 2), (3,), 6),
    "90": (15, 3, (9,), (1, 2), (2, 7), (0,), 10),
    "108": (9, 6, (3,), (1, 2), (1, 2), (3,), 10),
    "144": (12, 6, (3,), (1, 2), (1, 2), (3,), 12),
    "288": (12, 12, (3,), (2, 7), (1, 2), (3,), 18),
}
#: Other names.
ALIASES = {"bb72": "72", "bb90": "90", "bb108": "108", "bb144": "144", "gross": "144", "bb288": "288", "two-gross": "288", "twogross": "288"}


def preset_name(name: str) -> str:
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in PRESETS:
        raise ValueError(f"unknown code {name!r}; known: {', '.join([*PRESETS, *ALIASES])}")
    return key


def preset(spark: SparkSession, name: str) -> tuple[Css, list[DataFrame], list[DataFrame], int]:
    """A preset bivariate bicycle code, its terms, and its usual number of rounds."""
    size_x, size_y, ax, ay, bx, by, rounds = PRESETS[preset_name(name)]
    return (*bivariate_bicycle(spark, size_x, size_y, ax, ay, bx, by), rounds)


def css_violations(code: Css) -> DataFrame:
    """Pairs (cx, cz) of checks that share an odd number of variables; none for a CSS code."""
    x, z = code.hx.edges.select(F.col("c").alias("cx"), "v"), code.hz.edges.select(F.col("c").alias("cz"), "v")
    return x.join(z, "v").groupBy("cx", "cz").agg(F.count("*").alias("n")).where("n % 2 = 1")


def checked(code: Css) -> Css:
    if not css_violations(code).isEmpty():
        raise ValueError("hx hz' is not zero: not a CSS code")
    return code


def weights(code: Css) -> tuple[int, int]:
    """The largest column weight and the largest row weight of both matrices."""
    both = code.hx.edges, code.hz.edges
    column = max(variable_degrees(e).agg(F.max("dv")).first()[0] or 0 for e in both)
    return column, max(check_degrees(e).agg(F.max("dc")).first()[0] or 0 for e in both)


def girth(graph: Tanner) -> int:
    """Length of the shortest cycle, -1 without any. Leaves are pruned first, so a forest ends early."""
    from ..operators.cycles import Cycles
    from .scratch import written

    edges = written(graph.edges.select("c", "v").distinct(), "girth")
    while True:
        v = edges.groupBy("v").count().where("count >= 2").select("v")
        c = edges.groupBy("c").count().where("count >= 2").select("c")
        left = written(edges.join(v, "v", "left_semi").join(c, "c", "left_semi"), "girth")
        if left.isEmpty():
            return -1
        if left.count() == edges.count():
            break
        edges = left
    found, k = Cycles(Tanner(left.select("c", "v"), graph.checks, graph.variables).neighbours()), 2
    while not found.any(k):
        k += 1
    return 2 * k
