"""Document collections over the test tables, one for each kind of native structure.

| collection       | structure                                                                   |
| ---------------- | --------------------------------------------------------------------------- |
| customer_ledgers | month and status maps, entries array, risk tags, presence state              |
| user_timelines   | event stream, day map, properties with free keys                            |
| part_catalog     | tag array, supplier map                                                     |
| trade_parties    | several kinds of document in one collection                                 |
| nation_markets   | nested map of segment, ratios                                               |
| doc_profiles     | missing, null and present values                                            |
| threads          | array of turns                                                              |
| account_books    | months with entries, composite keys, roles, schedule, years, value states   |
| order_sheets     | lines by number, flags with totals, standings                               |
| supplier_seasons | seasons with capped fixtures, attribute timeline                            |
| region_leagues   | tables by year, both sides counted                                          |
| brand_matrices   | category matrices, inverted index of readings                               |
| part_measures    | wide rows as code maps                                                      |
| segment_panels   | a roll-up of account_books                                                  |
| nation_panels    | full outer join of keys, guarded ratios                                     |
| trade_graph      | adjacency maps                                                              |
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources import nest
from quern.sources.tables import table


def _beside(base: DataFrame, key: str, by: str, *parts: DataFrame) -> DataFrame:
    """base with the columns of parts, each unique by ``by``: left joins, so that parts a query doesn't use fall out of its plan."""
    for i, part in enumerate(parts):
        base = base.join(part.withColumnRenamed(by, f"__by{i}"), F.col(key) == F.col(f"__by{i}"), "left").drop(f"__by{i}")
    return base


def customer_ledgers(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    by = ["o_custkey"]
    money = {"order_count": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 4), "largest": F.max("o_totalprice")}
    months = nest.keyed_map(orders, by, nest.month(F.col("o_orderdate")), money, "activity_by_month")
    statuses = nest.keyed_map(orders, by, nest.safe_key(F.col("o_orderstatus")), money, "by_status")
    fields = {"order_key": F.col("o_orderkey"), "event_type": F.col("o_orderpriority"), "event_time": F.date_format("o_orderdate", "yyyy-MM-dd"), "status": F.col("o_orderstatus"), "amount": F.col("o_totalprice")}
    entries = nest.event_array(orders, by, [F.col("o_orderdate"), F.col("o_orderkey")], fields, "entries")
    nested = _beside(customer, "c_custkey", "o_custkey", months, statuses, entries)
    risk = nest.tags({"overdrawn": F.col("c_acctbal") < 0, "wealthy": F.col("c_acctbal") > 7500, "active": F.size("entries") >= 10, "idle": F.col("entries").isNull(), "automotive": F.col("c_mktsegment") == "AUTOMOBILE"})
    return nested.select(
        nest.key("customer", F.col("c_custkey")).alias("_id"), F.col("c_custkey").alias("customer_id"),
        F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"), risk.alias("risk_tags")).alias("identity"),
        F.struct(F.col("c_acctbal").alias("balance"), "by_status").alias("ledger"), F.struct("activity_by_month").alias("cashflow"), F.struct("entries").alias("timeline"),
        F.struct(nest.presence(F.col("entries")).alias("entries")).alias("schema_state"),
    )


def user_timelines(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("p", F.from_json("props", "map<string,bigint>"))
    by = ["user_id"]
    days = nest.keyed_map(events, by, F.date_format("ts", "yyyy-MM-dd"), {"event_count": F.count(F.lit(1)), "value_total": F.round(F.sum("value"), 4)}, "activity_by_day")
    fields = {"event_id": F.col("event_id"), "event_type": F.col("event_type"), "event_time": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "value": F.col("value"), "props": F.col("p")}
    stream = nest.event_array(events, by, [F.col("ts"), F.col("event_id")], fields, "events")
    return _beside(events.select("user_id").distinct(), "user_id", "user_id", days, stream).select(nest.key("user", F.col("user_id")).alias("_id"), "user_id", "events", "activity_by_day")


def part_catalog(spark: SparkSession, sf: str) -> DataFrame:
    part, lines = table(spark, sf, "part"), table(spark, sf, "lineitem")
    supply = nest.keyed_map(lines, ["l_partkey"], F.col("l_suppkey").cast("string"), {"quantity": F.sum("l_quantity"), "revenue": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4)}, "by_supplier")
    band = F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 35, "medium").otherwise("large")
    tags = F.array_sort(F.array_distinct(F.concat(F.split(F.lower("p_type"), " "), F.array(F.lower(F.col("p_brand")), band))))
    return part.join(supply, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        nest.key("part", F.col("p_partkey")).alias("_id"), F.col("p_partkey").alias("part_id"), F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("identity"), tags.alias("tags"), F.struct("by_supplier").alias("supply"),
    )


def trade_parties(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select(nest.key("customer", F.col("c_custkey")).alias("_id"), F.lit("customer").alias("entity_type"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("customer"), F.col("c_nationkey").alias("nation_id"))
    supplier = table(spark, sf, "supplier").select(nest.key("supplier", F.col("s_suppkey")).alias("_id"), F.lit("supplier").alias("entity_type"), F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("account")).alias("supplier"), F.col("s_nationkey").alias("nation_id"))
    return customer.unionByName(supplier, allowMissingColumns=True)


def nation_markets(spark: SparkSession, sf: str) -> DataFrame:
    nation, region, customer, supplier = (table(spark, sf, t) for t in ("nation", "region", "customer", "supplier"))
    segments = nest.keyed_map(customer, ["c_nationkey"], F.col("c_mktsegment"), {"customers": F.count(F.lit(1)), "balance": F.round(F.sum("c_acctbal"), 4), "in_debt": F.count_if(F.col("c_acctbal") < 0)}, "by_segment")
    supply = supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 4).alias("supplier_balance"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(segments, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(supply, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        nest.key("nation", F.col("n_nationkey")).alias("_id"), F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.struct("by_segment").alias("market"), F.struct("suppliers", "supplier_balance").alias("supply"),
    )


def doc_profiles(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.join(labels, "doc_id", "left").select(
        nest.key("doc", F.col("doc_id")).alias("_id"), "doc_id", F.struct("lang", "source", "n_chars").alias("profile"), F.when(F.col("quality").isNotNull(), F.struct("quality", "toxic")).alias("label"),
        F.struct(nest.presence(F.col("quality")).alias("label"), nest.presence(F.col("n_chars"), F.col("n_chars") < 200).alias("text")).alias("schema_state"),
    )


def threads(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    fields = {"turn": F.col("turn"), "role": F.col("role"), "n_chars": F.length("text").cast("long")}
    items = nest.event_array(turns, ["conv_id"], [F.col("turn")], fields, "items")
    roles = nest.keyed_map(turns, ["conv_id"], F.col("role"), {"turns": F.count(F.lit(1)), "chars": F.sum(F.length("text"))}, "turns_by_role")
    return items.join(roles, "conv_id").select(nest.key("conv", F.col("conv_id")).alias("_id"), "conv_id", F.struct("items").alias("answers"), "turns_by_role")


def account_books(spark: SparkSession, sf: str) -> DataFrame:
    """Months with their entries, composite operation keys, roles, a repayment schedule and years, of each customer."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    by, amount = ["o_custkey"], F.round(F.sum("o_totalprice"), 4)
    listed = lambda **f: F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(k) for k, c in f.items()))))
    months = nest.keyed_map(orders, by, nest.month(F.col("o_orderdate")), {"entry_count": F.count(F.lit(1)), "total": amount, "entries": listed(order_key="o_orderkey", type="o_orderstatus", amount="o_totalprice")}, "by_month")
    operations = nest.keyed_map(orders, by, nest.composite_key(F.col("o_orderstatus"), nest.safe_key(F.col("o_orderpriority"))), {"operations": F.count(F.lit(1)), "amount": amount}, "by_operation")
    roles = nest.keyed_map(orders, by, nest.safe_key(F.col("o_orderpriority")), {"cards": listed(order_key="o_orderkey", status="o_orderstatus")}, "by_role")
    due = nest.keyed_map(orders.where("o_orderstatus <> 'F'"), by, nest.month(F.add_months("o_orderdate", 12)), {"due": amount, "payments": F.count(F.lit(1))}, "by_due_month")
    years = nest.keyed_map(orders, by, F.date_format("o_orderdate", "yyyy"), {"orders": F.count(F.lit(1)), "total": amount, "open": F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0))}, "by_year")
    last = nest.latest(orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), by, ["o_orderdate", "o_orderkey"]).select("o_custkey", F.struct(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status")).alias("last"))
    return _beside(customer, "c_custkey", "o_custkey", months, operations, roles, due, years, last).select(
        nest.key("account", F.col("c_custkey")).alias("_id"), F.struct(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation_id")).alias("identity"), F.struct("by_month").alias("cashflow"),
        F.struct("by_operation").alias("counterparty"), F.struct("by_role").alias("disposition"), F.struct("by_due_month").alias("schedule"), F.struct("by_year").alias("career"), nest.value_state(F.col("last")).alias("last"), nest.value_state(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).alias("credit"),
    )


def order_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order by number, by return flag with totals, and by place in order of price."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    by = ["l_orderkey"]
    of_line = F.sort_array(F.collect_list(F.struct(F.col("l_quantity").isNull().alias("unknown"), F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"))))
    running = nest.keyed_map(lines, by, F.col("l_linenumber").cast("string"), {"order": of_line, "lines": F.count(F.lit(1))}, "by_line")
    entries = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))))
    flags = nest.keyed_map(lines, by, F.col("l_returnflag"), {"count": F.count(F.lit(1)), "quantity_total": F.round(F.sum("l_quantity"), 4), "price_total": F.round(F.sum("l_extendedprice"), 4), "entries": entries}, "by_flag")
    place = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    standings = nest.keyed_map(lines.where("l_extendedprice is not null").withColumn("place", F.row_number().over(place)), by, F.lpad(F.col("place").cast("string"), 3, "0"), {"price": F.max("l_extendedprice"), "line": F.max("l_linenumber")}, "by_position")
    pace = lines.groupBy("l_orderkey").agg(F.struct(F.count(F.lit(1)).alias("lines"), F.max("l_extendedprice").alias("best"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.min("l_quantity").alias("least")).alias("pace"))
    return _beside(orders, "o_orderkey", "l_orderkey", running, flags, standings, pace).select(
        nest.key("order", F.col("o_orderkey")).alias("_id"), F.struct(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy").alias("year")).alias("race"),
        F.struct("by_line").alias("running"), F.struct("by_flag").alias("results"), F.struct("by_position").alias("standings"), "pace",
    )


def supplier_seasons(spark: SparkSession, sf: str) -> DataFrame:
    """Years of a supplier: lines, quantities, returns, and its first 80 fixtures of each year; attributes by year as an array."""
    lines, supplier = table(spark, sf, "lineitem").withColumn("year", F.date_format("l_shipdate", "yyyy")), table(spark, sf, "supplier")
    nth = F.row_number().over(Window.partitionBy("l_suppkey", "year").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    fixture = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("result"))
    season = {"played": F.count(F.lit(1)), "quantity": F.round(F.sum("l_quantity"), 4), "returned": F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), "accepted": F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)), "fixtures": F.sort_array(F.collect_list(F.when(F.col("nth") <= 80, fixture)))}
    seasons = nest.keyed_map(lines.withColumn("nth", nth), ["l_suppkey"], F.col("year"), season, "by_year")
    rated = lines.groupBy("l_suppkey", "year").agg(F.round(F.avg("l_discount"), 6).alias("rating"), F.max("l_quantity").alias("strength"))
    timeline = rated.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("year", "rating", "strength"))).alias("timeline"))
    return _beside(supplier, "s_suppkey", "l_suppkey", seasons, timeline).select(
        nest.key("supplier", F.col("s_suppkey")).alias("_id"), F.struct(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_id")).alias("team"), F.struct("by_year").alias("seasons"), F.struct(F.col("timeline").alias("entries")).alias("attributes"),
    )


def region_leagues(spark: SparkSession, sf: str) -> DataFrame:
    """For each region and year the nations by number of sales, both sides counted: suppliers' lines and customers' orders."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    home = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("n"), F.date_format("l_shipdate", "yyyy").alias("year"), F.lit(1).alias("home"), F.lit(0).alias("away"))
    away = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n"), F.date_format("o_orderdate", "yyyy").alias("year"), F.lit(0).alias("home"), F.lit(1).alias("away"))
    teams = home.unionByName(away).groupBy("n", "year").agg(F.sum("home").alias("home"), F.sum("away").alias("away")).join(nation, F.col("n") == F.col("n_nationkey"))
    row = F.struct((-(F.col("home") + F.col("away"))).alias("order"), F.col("n_name").alias("nation"), (F.col("home") + F.col("away")).alias("played"), "home", "away")
    tables = nest.keyed_map(teams, ["n_regionkey"], F.col("year"), {"rows": F.transform(F.sort_array(F.collect_list(row)), lambda x: x.dropFields("order")), "played": F.sum(F.col("home") + F.col("away"))}, "by_year")
    return _beside(region, "r_regionkey", "n_regionkey", tables).select(nest.key("league", F.col("r_regionkey")).alias("_id"), F.col("r_name").alias("region"), F.struct("by_year").alias("tables"))


def brand_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Category by category: of each brand, lines by part type and year; readings by return flag and year, the first 40 of each."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("year", F.date_format("l_shipdate", "yyyy"))
    cells = nest.keyed_map(lines, ["p_brand", "p_type"], F.col("year"), {"lines": F.count(F.lit(1)), "quantity": F.round(F.sum("l_quantity"), 4)}, "by_year")
    matrix = nest.keyed_map(cells, ["p_brand"], nest.safe_key(F.col("p_type")), {"by_year": F.first("by_year")}, "by_type", ordered=False)
    nth = F.row_number().over(Window.partitionBy("p_brand", "l_returnflag", "year").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    reading = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_orderkey").alias("order_key"), F.col("l_quantity").alias("value"))
    years = nest.keyed_map(lines.withColumn("nth", nth).where("nth <= 40"), ["p_brand", "l_returnflag"], F.col("year"), {"readings": F.sort_array(F.collect_list(reading))}, "by_year")
    index = nest.keyed_map(years, ["p_brand"], F.col("l_returnflag"), {"by_year": F.first("by_year")}, "by_code", ordered=False)
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_set(F.col("p_type"))).alias("types"))
    return _beside(brands, "p_brand", "p_brand", matrix, index).select(nest.key("brand", nest.safe_key(F.col("p_brand"))).alias("_id"), F.col("p_brand").alias("brand"), "parts", "types", F.struct("by_type").alias("matrix"), F.struct("by_code").alias("readings"))


def part_measures(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of a part as codes: value, presence state, group and bucket."""
    part = table(spark, sf, "part").select("*", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 7 != 0, F.length("p_name").cast("double")).alias("name_length"))
    bucket = lambda v: F.when(v.isNull(), "unknown").when(v < 10, "low").when(v < 100, "middle").otherwise("high")
    codes = nest.code_map({"size": F.col("size"), "price": F.col("price"), "name_length": F.col("name_length")}, {"size": "shape", "price": "money", "name_length": "text"}, bucket)
    return part.select(nest.key("part", F.col("p_partkey")).alias("_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), codes.alias("codes"), nest.unpivot_map(["size", "price", "name_length"]).alias("values"))


def segment_panels(spark: SparkSession, sf: str) -> DataFrame:
    """A roll-up of documents that are built already: account_books by segment."""
    books = account_books(spark, sf).select("_id", F.col("identity.segment").alias("segment"), F.col("credit.presence_state").alias("credit"), F.explode_outer("career.by_year").alias("year", "own"))
    years = nest.keyed_map(books, ["segment"], F.col("year"), {"accounts": F.count(F.lit(1)), "orders": F.sum("own.orders"), "total": F.round(F.sum("own.total"), 2)}, "by_year")
    states = nest.keyed_map(books.dropDuplicates(["_id"]), ["segment"], F.col("credit"), {"accounts": F.count(F.lit(1))}, "by_credit")
    return years.join(states, "segment", "full").select(nest.key("panel", F.col("segment")).alias("_id"), "segment", F.struct("by_year").alias("years"), F.struct("by_credit").alias("credit"))


def nation_panels(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers of each nation that has either (a full outer join of keys), with guarded ratios."""
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    a = customer.groupBy(F.col("c_nationkey").alias("nation_id")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum(F.coalesce("c_acctbal", F.lit(0.0))), 2).alias("balance"))
    b = supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation_id")).agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum(F.coalesce("s_acctbal", F.lit(0.0))), 2).alias("account"))
    ratio = F.when(F.col("suppliers") > 0, F.round(F.col("customers") / F.col("suppliers"), 4))
    measures = F.map_filter(F.create_map(F.lit("customers"), F.col("customers").cast("double"), F.lit("suppliers"), F.col("suppliers").cast("double"), F.lit("per_supplier"), ratio), lambda _, v: v.isNotNull())
    return a.join(b, "nation_id", "full").select(nest.key("nation", F.col("nation_id")).alias("_id"), "nation_id", F.struct(F.coalesce("balance", F.lit(0.0)).alias("balance"), F.coalesce("account", F.lit(0.0)).alias("account")).alias("totals"), measures.alias("measures"))


def trade_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that trade, both ways: for each year, a nation's partners (who buys from it, and from whom it buys)."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = lines.where("l_returnflag = 'R'").select(F.date_format("l_shipdate", "yyyy").alias("year"), F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).distinct()
    return nest.adjacency(edges.where("a <> b"), "a", "b", ["year"], "neighbours").select(nest.key("year", F.col("year")).alias("_id"), "year", "neighbours")


BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (customer_ledgers, user_timelines, part_catalog, trade_parties, nation_markets, doc_profiles, threads, account_books, order_sheets, supplier_seasons, region_leagues, brand_matrices, part_measures, segment_panels, nation_panels, trade_graph)}


class World(Mapping[str, DataFrame]):
    """The collections of a directory of tables, each planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in BUILDERS:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = BUILDERS[name](self.spark, self.sf_dir)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(BUILDERS)

    def __len__(self) -> int:
        return len(BUILDERS)


#: Where the parts of collections come from: feature -> tables and columns.
PROVENANCE: dict[str, tuple[str, ...]] = {
    "account_books.cashflow": ("orders.o_orderdate", "orders.o_totalprice", "orders.o_orderstatus"), "account_books.counterparty": ("orders.o_orderstatus", "orders.o_orderpriority"), "account_books.schedule": ("orders.o_orderdate", "orders.o_totalprice"),
    "order_sheets.running": ("lineitem.l_linenumber", "lineitem.l_quantity"), "order_sheets.results": ("lineitem.l_returnflag",), "order_sheets.standings": ("lineitem.l_extendedprice",), "supplier_seasons.seasons": ("lineitem.l_shipdate", "lineitem.l_returnflag"),
    "region_leagues.tables": ("lineitem.l_suppkey", "orders.o_custkey", "nation.n_regionkey"), "brand_matrices.matrix": ("part.p_type", "lineitem.l_shipdate"), "part_measures.codes": ("part.p_size", "part.p_retailprice", "part.p_name"), "trade_graph.neighbours": ("supplier.s_nationkey", "customer.c_nationkey"),
}
