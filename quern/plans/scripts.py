"""Scalar functions, table lookups, inventories and spatial queries over parts, lines and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import coords as C
from quern.functions import names as B
from quern.functions import numbers as N
from quern.operators import inventory as I
from quern.operators import lookup as L
from quern.operators import spatial as S
from quern.runtime import table


def _ints(spark: SparkSession, sf: str) -> DataFrame:
    """Signed 32-bit numbers from part keys and prices, some of them near the limits."""
    part = table(spark, sf, "part")
    big = N.wrap32(F.col("p_partkey") * 2654435761 % (1 << 40))
    return part.select("p_partkey", big.alias("a"), (F.col("p_size") - 25).alias("b"), (F.floor("p_retailprice") % 100 - 50).cast("int").alias("c"))


def script_numbers(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return _ints(spark, sf).select(
        "p_partkey", N.add(a, a).alias("add"), N.sub(a, N.mul(a, F.lit(-3))).alias("sub"), N.mul(a, b).alias("mul"), N.div(a, b).alias("div"), N.mod(a, b).alias("mod"),
        N.interpolate(b, c, F.lit(3), F.lit(10), F.lit(17)).alias("interpolate"), N.add_percent(c, b).alias("add_percent"), N.scale(b, c, F.lit(7)).alias("scale"), N.absolute(a).alias("absolute"),
        F.least(b, c).alias("least"), F.greatest(b, c).alias("greatest"), N.power(b, F.lit(3)).alias("power"),
    )


def script_bits(spark: SparkSession, sf: str) -> DataFrame:
    a, n = F.col("a"), F.col("p_partkey") % 31
    n = n.cast("int")
    return _ints(spark, sf).select(
        "p_partkey", N.set_bit(a, n).alias("set_bit"), N.clear_bit(a, n).alias("clear_bit"), N.toggle_bit(a, n).alias("toggle_bit"), N.test_bit(a, n).alias("test_bit"), N.bit_count(a).cast("bigint").alias("bit_count"),
        N.get_bits(a, 4, 11).alias("get_bits"), N.set_bits(a, 4, 11).alias("set_bits"), N.clear_bits(a, 4, 11).alias("clear_bits"), N.put_bits(a, F.col("b") + 300, 4, 11).alias("put_bits"),
        a.bitwiseAND(F.col("b")).alias("both"), a.bitwiseOR(F.col("b")).alias("either"),
    )


def script_angles(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return _ints(spark, sf).select("p_partkey", N.sine(a).alias("sine"), N.cosine(a).alias("cosine"), N.angle(b, c).alias("angle"), N.root(F.abs(a % 1000), F.lit(2)).alias("root2"))


def script_strings(spark: SparkSession, sf: str) -> DataFrame:
    name, n = F.col("p_name"), F.col("p_size")
    signed = F.concat(name, F.when(n - 25 >= 0, "+").otherwise(""), (n - 25).cast("string"))
    order = F.when(name < F.col("p_type"), -1).when(name > F.col("p_type"), 1).otherwise(0)
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(name, n.cast("string")).alias("append_num"), signed.alias("append_signed"), F.lower(F.col("p_type")).alias("lowercase"), F.length(name).alias("length"),
        F.substring(name, 3, 4).alias("substring"), (F.instr(name, "a") - 1).alias("index_of"), order.alias("compare"), F.when(n == 1, name).otherwise(F.col("p_brand")).alias("text_switch"),
    )


def base37(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select("n_nationkey", B.encode(F.col("n_name")).alias("number"))
    return rows.select("n_nationkey", "number", B.decode(F.col("number")).alias("name"))


def base37_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_nodes").select("node_key", B.encode(F.col("label")).alias("number"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Parts on a grid: level, x, z from their keys."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", "p_size", (k % 2).cast("int").alias("level"), (3000 + k * 7919 % 400).cast("int").alias("x"), (3200 + k * 104729 % 400).cast("int").alias("z"))


def _searchers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", (k % 2).cast("int").alias("level"), (3000 + k * 6151 % 400).cast("int").alias("x"), (3200 + k * 3079 % 400).cast("int").alias("z"))


def packed_coord(spark: SparkSession, sf: str) -> DataFrame:
    rows = _points(spark, sf).withColumn("c", C.pack(F.col("level"), F.col("x"), F.col("z")))
    c = F.col("c")
    moved = C.move(c, F.lit(5), F.lit(1), F.lit(-7))
    inside = C.in_box(c, F.lit((3050 << 14) | 3250), F.lit((1 << 28) | (3300 << 14) | 3500))
    return rows.select("p_partkey", "c", C.level_of(c).alias("level"), C.x_of(c).alias("x"), C.z_of(c).alias("z"), moved.alias("moved"), C.distance(c, moved).alias("distance"), C.zone(C.x_of(c)).alias("zone_x"), C.map_square(C.z_of(c)).alias("square_z"), inside.alias("inside"))


def zone_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.within(_searchers(spark, sf), _points(spark, sf), 12, "s_suppkey", "p_partkey")
    return pairs.select("query", "point", "distance", "d2")


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    return S.nearest(S.within(_searchers(spark, sf), _points(spark, sf), 20, "s_suppkey", "p_partkey"))


def nearest_three(spark: SparkSession, sf: str) -> DataFrame:
    return S.nearest_ranked(S.within(_searchers(spark, sf), _points(spark, sf), 20, "s_suppkey", "p_partkey"), 3).select("query", "point", "rn")


def rectangle_count(spark: SparkSession, sf: str) -> DataFrame:
    x, z = F.col("x"), F.col("z")
    boxes = _searchers(spark, sf).select(F.col("s_suppkey").alias("box"), "level", (x - 30).alias("x0"), (z - 10).alias("z0"), (x + 30).alias("x1"), (z + 50).alias("z1"))
    return S.box_counts(boxes, _points(spark, sf))


def distance_sort(spark: SparkSession, sf: str) -> DataFrame:
    """The ten parts that are nearest to a fixed tile."""
    far = S.chebyshev(F.col("x"), F.col("z"), F.lit(3200), F.lit(3400))
    return _points(spark, sf).select("p_partkey", far.alias("distance")).orderBy("distance", "p_partkey").limit(10)


PARTS = L.TableSpec(1, {"kind": (("string",), True, None), "sizes": (("int", "int"), True, (7, 9)), "label": (("string",), False, ("none",))})


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as rows of two tables; sizes is a list of none to three pairs."""
    one = lambda x: F.array(F.struct(x.alias("f0")))
    pair = lambda i: F.struct((F.col("p_size") + i).alias("f0"), (F.col("p_size") * i).alias("f1"))
    sizes = F.filter(F.array(pair(0), pair(1), pair(0)), lambda x, i: i < F.col("p_partkey") % 4)
    return table(spark, sf, "part").select((1 + (F.col("p_partkey") % 10 == 0).cast("int")).alias("table_id"), F.col("p_partkey").alias("row_id"), one(F.col("p_type")).alias("kind"), sizes.alias("sizes"), F.when(F.col("p_size") > 25, one(F.col("p_brand"))).alias("label"))


def dbtable_find(spark: SparkSession, sf: str) -> DataFrame:
    return L.find(_rows(spark, sf), PARTS, "sizes", 20, 0)


def dbtable_find_unindexed(spark: SparkSession, sf: str) -> DataFrame:
    return L.find(_rows(spark, sf), PARTS, "label", "Brand#11").select("row_id", "ord")


def dbtable_refine(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return L.refine(L.find(rows, PARTS, "sizes", 20, 0), L.find(rows, PARTS, "kind", "ECONOMY")).select("row_id", "ord")


def dbtable_getfield(spark: SparkSession, sf: str) -> DataFrame:
    index = F.col("row_id") % 3
    return _rows(spark, sf).select("row_id", L.get_field(PARTS, "sizes", index, 1).alias("size"), L.get_field(PARTS, "label", F.lit(0)).alias("label"), L.field_count(PARTS, "sizes").alias("n"))


def dbtable_list(spark: SparkSession, sf: str) -> DataFrame:
    return L.list_all(_rows(spark, sf), PARTS).select("row_id", "ord")


def dbtable_by_index(spark: SparkSession, sf: str) -> DataFrame:
    found = L.list_all(_rows(spark, sf), PARTS)
    return L.by_index(found, 5).unionByName(L.by_index(found, 10_000_000))


def enum_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = {0: "south", 1: "west", 3: "east"}
    return table(spark, sf, "nation").select("n_nationkey", L.enum_value(names, F.col("n_regionkey"), "none").alias("side"))


def struct_param(spark: SparkSession, sf: str) -> DataFrame:
    params = F.create_map(F.lit(1), F.col("p_size"), F.lit(2), F.length("p_name"))
    kept = F.map_filter(params, lambda k, v: v % 2 == 0)
    return table(spark, sf, "part").select("p_partkey", L.param(kept, 1, -1).alias("p1"), L.param(kept, 3, 44).alias("p3"))


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("item"), (F.floor("l_quantity") * F.when(F.col("l_linenumber") == 1, 90_000_000).otherwise(1)).alias("amount"))


def inventory_totals(spark: SparkSession, sf: str) -> DataFrame:
    return I.totals(_inventory(spark, sf), ["owner", "item"])


def inventory_by_category(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category"))
    return I.totals(_inventory(spark, sf).join(kinds, "item"), ["category"])


def inventory_params(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), "p_size")
    return I.attribute_totals(_inventory(spark, sf), items, "p_size", ["owner"])


def inventory_space(spark: SparkSession, sf: str) -> DataFrame:
    free = I.free_space(_inventory(spark, sf), ["owner"], 7)
    return free.select("owner", "free", I.overflow(F.lit(0), F.col("free"), F.lit(4), F.lit(False)).cast("bigint").alias("overflow"))


QUERIES = {f.__name__: f for f in (script_numbers, script_bits, script_angles, script_strings, base37, base37_names, packed_coord, zone_range_scan, nearest, nearest_three, rectangle_count, distance_sort, dbtable_find, dbtable_find_unindexed, dbtable_refine, dbtable_getfield, dbtable_list, dbtable_by_index, enum_lookup, struct_param, inventory_totals, inventory_by_category, inventory_params, inventory_space)}

_WRAP = lambda x: f"CAST(((({x}) % 4294967296 + 4294967296 + 2147483648) % 4294967296) - 2147483648 AS INTEGER)"
_INTS = f"WITH i AS (SELECT p_partkey, {_WRAP('p_partkey * 2654435761 % 1099511627776')} AS a, p_size - 25 AS b, CAST(CAST(floor(p_retailprice) AS BIGINT) % 100 - 50 AS INTEGER) AS c FROM part), w AS (SELECT p_partkey, a::HUGEINT AS a, b::HUGEINT AS b, c::HUGEINT AS c, CAST(p_partkey % 31 AS INTEGER) AS n FROM i) "
_U = lambda x: f"(({x}) & 4294967295)"
_BITS = _INTS.replace("HUGEINT", "BIGINT")
_POINTS = "p AS (SELECT p_partkey, p_partkey % 2 AS level, 3000 + p_partkey * 7919 % 400 AS x, 3200 + p_partkey * 104729 % 400 AS z FROM part), s AS (SELECT s_suppkey, s_suppkey % 2 AS level, 3000 + s_suppkey * 6151 % 400 AS x, 3200 + s_suppkey * 3079 % 400 AS z FROM supplier)"
_PAIRS = lambda r: f"WITH {_POINTS}, j AS (SELECT s_suppkey AS query, p_partkey AS point, p.x AS px, p.z AS pz, greatest(abs(p.x - s.x), abs(p.z - s.z)) AS distance, (p.x - s.x) * (p.x - s.x) + (p.z - s.z) * (p.z - s.z) AS d2 FROM s JOIN p ON s.level = p.level AND abs(p.x - s.x) <= {r} AND abs(p.z - s.z) <= {r}) "
_DB = "WITH r AS (SELECT p_partkey AS row_id, 1 + (p_partkey % 10 = 0)::INT AS table_id, p_type AS kind, p_size AS s, CAST(p_partkey % 4 AS INTEGER) AS m, CASE WHEN p_size > 25 THEN p_brand END AS label FROM part), f AS (SELECT table_id, row_id, kind, i FROM r, (SELECT unnest([0, 1, 2]) AS i) WHERE table_id = 1 AND i < m AND s + [0, 1, 0][i + 1] = 20) "
_INV = "WITH v AS (SELECT l_orderkey AS owner, l_linenumber AS slot, l_partkey AS item, CAST(floor(l_quantity) AS BIGINT) * CASE WHEN l_linenumber = 1 THEN 90000000 ELSE 1 END AS amount FROM lineitem) "
ORACLE = {
    "script_numbers": _INTS + f"""SELECT p_partkey, {_WRAP('a + a')} AS add, {_WRAP(f"a - {_WRAP('a * -3')}")} AS sub, {_WRAP('a * b')} AS mul, CAST(CASE WHEN b = 0 THEN 0 ELSE trunc(a::DOUBLE / b::DOUBLE) END AS INTEGER) AS div, CAST(CASE WHEN b = 0 THEN 0 ELSE a % b END AS INTEGER) AS mod,
CAST(floor((c - b)::DOUBLE / 7.0) * 14 + b AS INTEGER) AS interpolate, CAST(trunc((c * b)::DOUBLE / 100.0 + c::DOUBLE) AS INTEGER) AS add_percent, CAST(CASE WHEN c = 0 THEN 0 ELSE trunc((b * 7)::DOUBLE / c::DOUBLE) END AS INTEGER) AS scale, {_WRAP('abs(a)')} AS absolute,
CAST(least(b, c) AS INTEGER) AS least, CAST(greatest(b, c) AS INTEGER) AS greatest, CAST(b * b * b AS INTEGER) AS power FROM w""",
    "script_bits": _BITS + f"""SELECT p_partkey, {_WRAP(f"({_U('a')} | (1::BIGINT << n))")} AS set_bit, {_WRAP(f"({_U('a')} & ~(1::BIGINT << n))")} AS clear_bit, {_WRAP(f"xor({_U('a')}, (1::BIGINT << n))")} AS toggle_bit, CAST(({_U('a')} >> n) & 1 AS INTEGER) AS test_bit, bit_count({_U('a')})::BIGINT AS bit_count,
CAST(({_U('a')} >> 4) & 255 AS INTEGER) AS get_bits, {_WRAP(f"({_U('a')} | 4080)")} AS set_bits, {_WRAP(f"({_U('a')} & ~4080::BIGINT)")} AS clear_bits, {_WRAP(f"(({_U('a')} & ~4080::BIGINT) | (least(b + 300, 255) << 4))")} AS put_bits, {_WRAP(f"({_U('a')} & {_U('b')})")} AS both, {_WRAP(f"({_U('a')} | {_U('b')})")} AS either FROM w""",
    "script_angles": _BITS + f"SELECT p_partkey, CAST(trunc(sin(({_U('a')} & 16383) * (2 * pi() / 16384)) * 16384) AS INTEGER) AS sine, CAST(trunc(cos(({_U('a')} & 16383) * (2 * pi() / 16384)) * 16384) AS INTEGER) AS cosine, CAST((CAST(floor(atan2(b::DOUBLE, c::DOUBLE) * (16384 / (2 * pi())) + 0.5) AS BIGINT) + 16384) % 16384 AS INTEGER) AS angle, CAST(trunc(sqrt(abs(a % 1000))) AS INTEGER) AS root2 FROM w",
    "script_strings": "SELECT p_partkey, p_name || p_size AS append_num, p_name || CASE WHEN p_size >= 25 THEN '+' ELSE '' END || (p_size - 25) AS append_signed, lower(p_type) AS lowercase, length(p_name) AS length, substring(p_name, 3, 4) AS substring, instr(p_name, 'a') - 1 AS index_of, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS compare, CASE WHEN p_size = 1 THEN p_name ELSE p_brand END AS text_switch FROM part",
    "base37": "WITH d AS (SELECT n_nationkey, list_transform(string_split(substring(lower(n_name), 1, 12), ''), lambda c: greatest(instr('_abcdefghijklmnopqrstuvwxyz0123456789', c) - 1, 0)) AS ds FROM nation) SELECT n_nationkey, CAST(list_reduce(list_prepend(0::HUGEINT, ds), lambda x, y: x * 37 + y) AS BIGINT) AS number, CASE WHEN ds[-1] = 0 THEN 'invalid_name' ELSE ltrim(array_to_string(list_transform(ds, lambda x: substring('_abcdefghijklmnopqrstuvwxyz0123456789', x::INTEGER + 1, 1)), ''), '_') END AS name FROM d",
    "base37_names": "WITH d AS (SELECT node_key, list_transform(string_split(substring(lower(trim(label)), 1, 12), ''), lambda c: greatest(instr('_abcdefghijklmnopqrstuvwxyz0123456789', c) - 1, 0)) AS ds FROM page_nodes) SELECT node_key, CAST(list_reduce(list_prepend(0::HUGEINT, ds), lambda x, y: x * 37 + y) AS BIGINT) AS number FROM d",
    "packed_coord": f"WITH {_POINTS}, q AS (SELECT *, CAST((level << 28) | (x << 14) | z AS INTEGER) AS c FROM p) SELECT p_partkey, c, CAST(level AS INTEGER) AS level, CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z, CAST(((level + 1) << 28) | ((x + 5) << 14) | (z - 7) AS INTEGER) AS moved, 7 AS distance, CAST(x // 8 AS INTEGER) AS zone_x, CAST(z // 64 AS INTEGER) AS square_z, x BETWEEN 3050 AND 3300 AND z BETWEEN 3250 AND 3500 AS inside FROM q",
    "zone_range_scan": _PAIRS(12) + "SELECT query, point, distance, d2 FROM j",
    "nearest": _PAIRS(20) + "SELECT query, point, d2 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, px, pz, point DESC) AS rn FROM j) WHERE rn = 1",
    "nearest_three": _PAIRS(20) + "SELECT query, point, rn FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, d2, point) AS rn FROM j) WHERE rn <= 3",
    "rectangle_count": f"WITH {_POINTS} SELECT s_suppkey AS box, count(p_partkey) AS n FROM s LEFT JOIN p ON s.level = p.level AND p.x BETWEEN s.x - 30 AND s.x + 30 AND p.z BETWEEN s.z - 10 AND s.z + 50 GROUP BY 1",
    "distance_sort": f"WITH {_POINTS} SELECT p_partkey, greatest(abs(x - 3200), abs(z - 3400)) AS distance FROM p ORDER BY 2, 1 LIMIT 10",
    "dbtable_find": _DB + "SELECT table_id, row_id, CAST(row_number() OVER (ORDER BY row_id, i) - 1 AS INTEGER) AS ord FROM f",
    "dbtable_find_unindexed": "SELECT p_partkey AS row_id, 0 AS ord FROM part WHERE false",
    "dbtable_refine": _DB + "SELECT row_id, CAST(row_number() OVER (ORDER BY row_id, i) - 1 AS INTEGER) AS ord FROM f WHERE kind = 'ECONOMY'",
    "dbtable_getfield": _DB + "SELECT row_id, CASE WHEN table_id = 1 AND row_id % 3 < m THEN s * [0, 1, 0][row_id % 3 + 1] ELSE 9 END AS size, CASE WHEN table_id = 1 AND label IS NOT NULL THEN label ELSE 'none' END AS label, CASE WHEN table_id = 1 THEN m ELSE 0 END AS n FROM r",
    "dbtable_list": _DB + "SELECT row_id, CAST(row_number() OVER (ORDER BY row_id) - 1 AS INTEGER) AS ord FROM r WHERE table_id = 1",
    "dbtable_by_index": _DB + ", l AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS ord FROM r WHERE table_id = 1) SELECT row_id FROM l WHERE ord = 5 UNION ALL SELECT -1",
    "enum_lookup": "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 3 THEN 'east' ELSE 'none' END AS side FROM nation",
    "struct_param": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END AS p1, 44 AS p3 FROM part",
    "inventory_totals": _INV + "SELECT owner, item, CAST(least(sum(amount), 2147483647) AS BIGINT) AS total FROM v GROUP BY 1, 2",
    "inventory_by_category": _INV + "SELECT p_type AS category, CAST(least(sum(amount), 2147483647) AS BIGINT) AS total FROM v JOIN part ON item = p_partkey GROUP BY 1",
    "inventory_params": _INV + "SELECT owner, CAST(sum(p_size) AS BIGINT) AS per_slot, CAST(sum(p_size * amount) AS BIGINT) AS per_unit FROM v JOIN part ON item = p_partkey GROUP BY 1",
    "inventory_space": _INV + "SELECT owner, 7 - count(DISTINCT slot) AS free, greatest(0, 4 - (7 - count(DISTINCT slot))) AS overflow FROM v GROUP BY 1",
}
