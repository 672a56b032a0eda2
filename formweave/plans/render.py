"""Forms rendered from the driver's tables: phrase layouts whose content is known.

A document holds the orders of a key range, a page two of them.  Every record has
three rows of key-value pairs and a table of its lines; see ``FIELDS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

KV_FIELDS = ("Order Key", "Customer", "Status", "Order Date", "Priority", "Total Price")
TABLE_FIELDS = ("Line", "Part", "Supplier", "Quantity", "Price", "Discount", "Ship Date")
#: Columns of the inner tables of deep forms.
DEEP_FIELDS = (("Mode", "Flag", "Tax", "Batch"), ("Grade", "Lot"))
#: Orders of one document, records of one page, rows kept for a record.
SPAN, PER_PAGE, RECORD_ROWS = 50, 2, 24
#: Visual rows of a record before its lines, the page's title (of the first record of a page) counted.
HEAD_ROWS = 5
#: Lines whose documents one task renders, about.
LINES_PER_PART = 40_000

#: The rendered values as DuckDB SQL; ``lines`` and ``heads`` are what extraction must give back.
DUCK_SOURCE = f"""
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ALL_LINE_COLUMNS) AS n FROM lineitem),
o AS (SELECT *, o_orderkey // {SPAN} AS d, row_number() OVER (PARTITION BY o_orderkey // {SPAN} ORDER BY o_orderkey) - 1 AS rk
      FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
lines AS (SELECT 'forms_' || d AS doc_id, rk AS record_id, n AS row_no, n::VARCHAR AS v0, l_partkey::VARCHAR AS v1, l_suppkey::VARCHAR AS v2, l_quantity::DECIMAL(18,2)::VARCHAR AS v3,
      l_extendedprice::DECIMAL(18,2)::VARCHAR AS v4, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount::DECIMAL(18,2)::VARCHAR END AS v5, strftime(l_shipdate, '%Y-%m-%d') AS v6 FROM o JOIN l ON l_orderkey = o_orderkey),
heads AS (SELECT 'forms_' || d AS doc_id, rk AS record_id, o_orderkey::VARCHAR AS v0, o_custkey::VARCHAR AS v1, o_orderstatus AS v2, strftime(o_orderdate, '%Y-%m-%d') AS v3, o_orderpriority AS v4, o_totalprice::DECIMAL(18,2)::VARCHAR AS v5 FROM o)
"""


def _parts(spark: SparkSession, lines: DataFrame) -> int:
    """Parts to deal forms to: their phrases and what later steps sort of them fit a task's memory, however many lines there are."""
    return max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_PER_PART))


def _forms(spark: SparkSession, sf_dir: str, variant: str = "", odd: str = "forms_") -> DataFrame:
    """As ``forms``, with part: 0 the page's header, 1 pairs, 2 the table; ``odd`` is what names of documents of odd numbers begin with.

    Orders and lines are dealt by document, once; phrases are made where a document's orders have met.
    """
    inserted, height = {"nested": 2, "deep": 5}.get(variant, 0), 30 if variant == "deep" else RECORD_ROWS
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    day = lambda c: F.col(c).cast("date").cast("string")
    named = lambda d: F.concat(F.when(F.abs(d) % 2 == 1, odd).otherwise("forms_"), d)
    keyed = [
        frame.where(F.col(key).isNotNull()).select(named(F.floor(F.col(key) / SPAN)).alias("doc_id"), F.col(key).alias("k"), F.struct(*frame.columns).alias(name))
        for frame, key, name in ((orders, "o_orderkey", "o"), (lines, "l_orderkey", "l"))
    ]
    dealt = keyed[0].unionByName(keyed[1], allowMissingColumns=True).repartition(_parts(spark, lines), "doc_id")
    met = dealt.groupBy("doc_id", "k").agg(F.collect_list("o").alias("o"), F.array_sort(F.collect_list("l")).alias("l")).where("size(o) > 0 AND size(l) > 0")
    own = Window.partitionBy("doc_id").orderBy("k")
    records = met.select("doc_id", "k", "l", F.size("l").alias("size"), F.explode("o").alias("o")).withColumn("rk", F.row_number().over(own) - 1)
    # the second record of a page stands below the first one, however many lines that has
    second = F.greatest(F.lit(height), 4 + inserted + F.lag("size").over(own))
    records = records.withColumn("page", (F.floor(F.col("rk") / PER_PAGE) + 1).cast("int")).withColumn("top", F.when(F.col("rk") % PER_PAGE == 0, 0).otherwise(second))
    said = lambda word, c="": F.concat(F.lit(f"{word} "), F.col(c)) if c else F.lit(word)
    inner = []
    if variant == "nested":
        inner = [[None, said("Mode"), said("Flag")], [None, said("mode", "l_linestatus"), said("flag", "l_returnflag")]]
    elif variant == "deep":
        inner = [
            [None, *(said(f) for f in DEEP_FIELDS[0])],
            [None, said("mode", "l_suppkey"), said("flag", "l_partkey"), said("tax", "l_suppkey"), said("batch", "l_partkey")],
            [None, None, *(said(f) for f in DEEP_FIELDS[1])],
            [None, None, said("grade", "l_suppkey"), said("lot", "l_partkey")],
            [None, said("again", "l_suppkey"), said("more", "l_partkey"), said("rate", "l_suppkey"), said("last", "l_partkey")],
        ]
    # a record's visual rows: the page's title, three rows of pairs, the table's header, then lines, with the inner rows after the first one
    lines_at = F.concat(F.array_repeat(F.element_at("l", 1), 1 + inserted), F.slice("l", 2, F.size("l"))) if inserted else F.col("l")
    rows = records.select("doc_id", "rk", "page", "top", "o", F.posexplode_outer(F.concat(F.array_repeat(F.lit(None), HEAD_ROWS), lines_at)).alias("p", "l"))
    rows = rows.where((F.col("p") > 0) | (F.col("rk") % PER_PAGE == 0)).select("doc_id", "rk", "page", "top", "p", F.when(F.col("p") < HEAD_ROWS, F.col("o")).alias("o"), "l").select("doc_id", "rk", "page", "top", "p", "o.*", "l.*")

    lit = lambda *names: [F.lit(n) for n in names]
    values = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), day("o_orderdate"), F.col("o_orderpriority"), money("o_totalprice")]
    pairs = [v for k, x in zip(lit(*KV_FIELDS), values, strict=True) for v in (k, x)]
    number = F.when(F.col("p") == HEAD_ROWS, 1).otherwise(F.col("p") - (HEAD_ROWS - 1 + inserted))
    discount = F.when(F.col("l_discount") != 0, money("l_discount"))
    body = [number.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), money("l_quantity"), money("l_extendedprice"), discount, day("l_shipdate")]
    known = [[F.lit("Order Report"), F.concat(F.lit("Sheet "), F.col("page"))], *(pairs[4 * k : 4 * k + 4] for k in range(3)), lit(*TABLE_FIELDS)]
    known = dict(enumerate(known)) | {HEAD_ROWS + 1 + k: line for k, line in enumerate(inner)}

    def text(c: int) -> F.Column:
        """The text in a column of a visual row: of the rows of a line all but the few known places."""
        found = F.when(F.lit(False), F.lit(None).cast("string"))
        for at, line in known.items():
            found = found.when(F.col("p") == at, line[c] if c < len(line) and line[c] is not None else F.lit(None).cast("string"))
        return found.otherwise(body[c])

    columns = [f"t{c}" for c in range(len(body))]
    rows = rows.select("doc_id", "rk", "page", "top", "p", *(text(c).alias(name) for c, name in enumerate(columns)))
    there = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns]
    ahead = F.sum("size").over(Window.partitionBy("doc_id").orderBy("rk", "p")) - F.col("size")
    rows = rows.withColumn("size", sum(there[1:], there[0])).withColumn("ahead", ahead.cast("int"))
    cells = [F.struct(F.lit(c).alias("c"), sum(there[:c], F.col("ahead")).alias("phrase_idx"), F.col(name).alias("text")) for c, name in enumerate(columns)]
    flat = rows.select("doc_id", "page", "top", "p", F.inline(F.array(*cells))).where("text IS NOT NULL")
    shift = F.when((F.col("c") == 3) & (F.col("p") >= HEAD_ROWS) & ((F.col("p") - HEAD_ROWS + 1) % 3 == 0), F.lit(50.0)).otherwise(0.0) if variant == "shifted" else F.lit(0.0)
    x0, y0 = 40.0 + 90 * F.col("c") + shift, 40.0 + 14 * F.when(F.col("p") == 0, 0).otherwise(F.col("top") + F.col("p"))
    part = F.when(F.col("p") == 0, 0).when(F.col("p") < HEAD_ROWS - 1, 1).otherwise(2)
    return flat.select(
        "doc_id", "phrase_idx", "page", "text",
        x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.lit(80.0), 6.0 * F.length("text"))).alias("x1"), (y0 + 10).alias("y1"), part.alias("part"),
    )


def forms(spark: SparkSession, sf_dir: str, variant: str = "") -> DataFrame:
    """phrases (doc_id, phrase_idx, page, text, x0, y0, x1, y1), dealt by document; cells without a discount are left out.

    Variants: ``shifted`` moves every third line's quantity beside its header but within
    its column; ``nested`` puts a sub-table after each first line, ``deep`` one of four columns that
    has a table of two of them between its two rows.
    """
    return _forms(spark, sf_dir, variant).drop("part")


def form_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of all forms, from the keys alone: nothing is rendered."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("k")) for t, c in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
    return orders.join(lines, "k", "left_semi").select(F.concat(F.lit("forms_"), F.floor(F.col("k") / SPAN)).alias("doc_id")).distinct()


#: The other layout: what its fields are called, and which columns of the table it has.
BILL_FIELDS = ("Invoice", "Buyer", "State", "Invoice Date", "Urgency", "Amount Due")
BILL_COLUMNS = {0: "Item", 1: "Article", 3: "Units", 4: "Sum", 6: "Sent On"}


def two_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of even documents, and those of odd ones as bills: other names, fewer columns.  Dealt by document, as the forms are."""
    phrases = _forms(spark, sf_dir, odd="bills_")
    odd = F.col("doc_id").startswith("bills_")
    names = dict(zip(KV_FIELDS, BILL_FIELDS, strict=True)) | {TABLE_FIELDS[c]: name for c, name in BILL_COLUMNS.items()} | {"Order Report": "Bill Report"}
    renamed = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    kept = ~odd | (F.col("part") < 2) | F.round((F.col("x0") - 40) / 90).cast("int").isin(*BILL_COLUMNS)
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("phrase_idx")) - 1
    text = F.when(odd, F.coalesce(F.element_at(renamed, F.col("text")), F.col("text"))).otherwise(F.col("text"))
    return phrases.where(kept).withColumn("phrase_idx", again).withColumn("text", text).drop("part")
