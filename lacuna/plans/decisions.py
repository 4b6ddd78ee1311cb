"""Decision-shaped texts from the orders and customers tables, as pieces that SQL of any dialect can put together.

Every piece has its expression over the order's columns, the kind of its gold span, and what the two rule packs write
instead (None: it stays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a part: at ten mentions a row its tables take some 100 MB.
PART_ROWS = 50_000


def _pick(values: str, number: str, n: int) -> str:
    return f"split_part('{values}', ',', CAST({number} % {n} AS INT) + 1)"


#: Named parts of a decision; all names are invented.
PARTS = {
    "given": _pick("Alwin,Berta,Cosima,Detlev,Edda,Fridolin,Gesine,Hulda", "o_custkey", 8),
    "surname": _pick("Ahorner,Birkmann,Distler,Erlacher,Felber,Ginster,Holder,Iriser,Kressig,Lorbeer,Malvner", "o_custkey", 11),
    "owner": _pick("Quarzner,Basalter,Gneiser,Schieferin,Marmorin,Tuffer,Granitz", "o_orderkey", 7),
    "town": _pick("Ahorndorf,Birkenwil,Distelheim,Erlenthal,Farnbach,Ginsterau,Haselried", "o_custkey", 7),
    "zip": _pick("4901,4902,4903,4904,4905,4906,4907", "o_custkey", 7),
    "seat": _pick("Nussbergen,Oleandern,Pappelegg", "o_orderkey", 3),
    "street": _pick("Amselgasse,Drosselweg,Finkenrain,Meisenstrasse", "o_orderkey", 4),
    "judge": _pick("Falkner,Habichter,Milaner", "o_orderkey", 3),
    "clerk": _pick("Reiherin,Storcher", "o_orderkey", 2),
    "lawyer": _pick("Dorothea Kranichner,Xaver Schwaner", "o_orderkey", 2),
    "mail": "'person' || CAST(o_custkey AS STRING) || '@brief.example.ch'",
    "phone": "'079 ' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ' 13 31'",
    "docket": "'ZK.2031.' || lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')",
    "house": "CAST(o_orderkey % 90 + 1 AS STRING)",
}
_NL = "chr(10)"
AUTHORITY, OFFICE = "Finanzdirektion des Kantons Bern", "Mattenweg 14, 3011 Bern"

#: (expression, gold kind, gold entity, federal replacement, Zurich replacement)
PIECES = (
    (f"'Mitwirkend:' || {_NL} || 'Oberrichterin '", None, None, None, None),
    ("judge", None, None, None, "A."),
    (f"', Vorsitz, und' || {_NL} || 'Gerichtsschreiberin '", None, None, None, None),
    ("clerk", None, None, None, "B"),
    (f"'.' || {_NL} || 'Verfahrensbeteiligte' || {_NL}", None, None, None, None),
    ("given || ' ' || surname", "person", "A", "A.________", "C."),
    ("', '", None, None, None, None),
    ("street || ' ' || house || ', ' || zip || ' ' || town", "address", "A#address", "[…]", "[…]"),
    (f"',' || {_NL} || 'Klägerin, vertreten durch Rechtsanwältin '", None, None, None, None),
    ("lawyer", None, None, None, "D."),
    (f"',' || {_NL} || 'und' || {_NL}", None, None, None, None),
    ("owner || ' Keramik'", "company", "B", "B.________", "E."),
    ("' AG, mit Sitz in '", None, None, None, None),
    ("seat", "place", "V", "V.________", "V."),
    (f"',' || {_NL} || '{AUTHORITY}, {OFFICE},' || {_NL} || 'Streitsache' || {_NL} || 'Klage gegen die Verfügung '", None, None, None, None),
    ("docket", None, None, None, None),
    ("' der Gemeinde '", None, None, None, None),
    ("town", "place", "U", "U.________", "U"),
    (f"'.' || {_NL} || 'Erwägungen: '", None, None, None, None),
    ("surname", "person", "A", "A.________", "C."),
    ("' erreicht man unter '", None, None, None, None),
    ("mail", None, None, "[…]", "[…]"),
    ("' oder '", None, None, None, None),
    ("phone", None, None, "[…]", "[…]"),
    ("' am Abend. '", None, None, None, None),
    ("surname || 's'", "person", "A", "A.________", "C."),
    (f"' Begehren dringt nicht durch.' || {_NL}", None, None, None, None),
)

#: Labelled mentions: (expression, type, role).
MENTIONS = (
    ("judge", "court_official", "judge"), ("clerk", "court_official", "clerk"), ("given || ' ' || surname", "private_person", "Klägerin"),
    ("lawyer", "lawyer", "lawyer"), ("owner || ' Keramik AG'", "private_company", "Beklagte"), ("town", "residence", ""), ("town", "place", ""),
    ("seat", "residence", ""), (f"'{AUTHORITY}'", "authority", ""), ("surname", "private_person", "Klägerin"),
)


def text_sql() -> str:
    return " || ".join(f"({p[0]})" for p in PIECES)


def output_sql(pack: str) -> str:
    """The text a rule pack must give, from the pieces alone."""
    column = 3 if pack == "bger-2020" else 4
    return " || ".join(f"'{p[column]}'" if p[column] else f"({p[0]})" for p in PIECES)


def parts_sql() -> str:
    return ", ".join(f"{e} AS {n}" for n, e in PARTS.items())


def base_sql() -> str:
    """The orders with the parts of their decisions, as SQL."""
    return f"SELECT CAST(o_orderkey AS STRING) AS doc_id, {parts_sql()} FROM orders JOIN customer ON o_custkey = c_custkey"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr("CAST(o_orderkey AS STRING) AS doc_id", "o_orderkey", "o_custkey")
    return spread(rows, orders).selectExpr("doc_id", *(f"{e} AS {n}" for n, e in PARTS.items()))


def spread(rows: DataFrame, counted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows by their key, in parts of about ``PART_ROWS`` rows of the table that is counted.

    A few numbers make a long text that is costly to read: the rows are spread before they grow, by the key of all that
    follows, which then needs no shuffle of its own; and the parts stay as small when the tables grow.
    """
    parts = -(-counted.count() // PART_ROWS)
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, parts), key)


def documents(rows: DataFrame, *more: str) -> DataFrame:
    return rows.selectExpr("doc_id", f"{text_sql()} AS text", "CAST(NULL AS STRING) AS legal_area", *more)


LABELLED = "array<struct<seq:bigint,text:string,type:string,role:string,source:string>>"


def labelled() -> Column:
    """The labelled mentions of a decision, in order, as an array."""
    spots = [F.struct(F.lit(k).cast("long").alias("seq"), F.expr(e).alias("text"), F.lit(t).alias("type"), F.lit(r).alias("role"), F.lit("labeler").alias("source")) for k, (e, t, r) in enumerate(MENTIONS)]
    return F.array(*spots)


def labels(rows: DataFrame) -> DataFrame:
    """The labelled mentions of every decision, in order."""
    return rows.select("doc_id", F.inline(labelled()))


def cases(rows: DataFrame, *more: str) -> DataFrame:
    """Benchmark cases with gold spans at the pieces' places and the official's and lawyer's names to keep."""
    at, gold = "0", []
    for e, kind, entity, *_ in PIECES:
        if kind:
            gold.append(f"named_struct('start', {at}, 'end', {at} + char_length({e}), 'text', {e}, 'entity', '{entity}', 'kind', '{kind}')")
        at = f"{at} + char_length({e})"
    keep = ", ".join(f"named_struct('text', {n}, 'kind', '{k}', 'count', 1)" for n, k in (("judge", "court_official"), ("clerk", "court_official"), ("lawyer", "lawyer")))
    return rows.selectExpr("doc_id AS id", "'de' AS language", f"{text_sql()} AS text", f"array({', '.join(gold)}) AS gold", f"array({keep}) AS keep", *more)
