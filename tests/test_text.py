import time
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from martwright.functions.arrays import LAST_SEEN, MOST, SUM, running
from martwright.functions import labels, money
from martwright.functions.keys import date_key, surrogate_key
from martwright.functions.text import pack_text, parse_price, unpack_text
from martwright.plans import guarded
from martwright.sources.html_tables import extract_html_tables


def test_parse_price(spark):
    texts = ["$1,249.00", " € 9.50", "1.249.00", "", "N/A", None, "12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parse_price(F.col("t"))).collect()] == [1249.0, 9.5, 0.0, 0.0, 0.0, 0.0, 12.0]


def test_labels(spark):
    row = spark.sql("select -1.5d a, 2.25d b, cast(null as double) c, 40 d, 25 e, 24.9 f, date'2024-08-31' g").select(
        labels.price_direction(F.col("a")), labels.price_direction(F.col("b")), labels.price_direction(F.col("c")),
        labels.margin_band(F.col("d")), labels.margin_band(F.col("e")), labels.margin_band(F.col("f")),
        labels.season(F.col("g")), labels.format_growth(F.col("a")), labels.format_growth(F.col("c")), labels.format_growth(F.col("d")),
        labels.format_money(F.lit(1234.6)), labels.format_pct(F.lit(12.34)), date_key(F.col("g")),
    ).first()
    assert list(row) == ["▼ $1.50", "▲ $2.25", "N/A", "high", "medium", "low", "Summer", "-1.5%", "—", "+40%", "$1,235", "12.3%", 20240831]


def test_spend_bands(spark):
    df = spark.createDataFrame([(v,) for v in (999, 1000, 4000, 4001, 5000, 8001, 15000, 15001)], "v int")
    got = [tuple(r) for r in df.select(labels.spend_segment(F.col("v")), labels.clv_band(F.col("v"))).collect()]
    assert [g[0] for g in got] == ["Standard", "Standard", "Standard", "Mid Value", "Mid Value", "High Value", "High Value", "VIP"]
    assert [g[1][:3] for g in got] == ["Sta", "Mid", "Mid", "Mid", "Hig", "Hig", "VIP", "VIP"]


def test_tiers(spark):
    df = spark.createDataFrame([(5, 4, 4), (4, 3, 3), (3, 2, 2), (4, 1, 1), (1, 4, 1), (1, 1, 4), (1, 1, 1)], "r int, f int, m int")
    got = [r[0] for r in df.select(labels.clv_tier(F.col("r"), F.col("f"), F.col("m"))).collect()]
    assert got == ["Champions", "Loyal", "Potential Loyal", "Recent", "At Risk", "At Risk", "Hibernating"]


def test_money(spark):
    df = spark.sql("select cast(1.005 as decimal(10,3)) a, 0 z, cast(-2.345 as decimal(10,3)) n, cast(null as decimal(5,4)) d")
    row = df.select(
        money.money(F.col("a")), money.money(F.col("n")), money.safe_ratio(F.col("a"), F.col("z")),
        money.clamp(F.col("d")), money.clamp(F.lit(3)), money.clamp(F.lit(-3)), money.margin_pct(F.col("z"), F.col("a")),
    ).first()
    assert [None if v is None else float(v) for v in row] == [1.01, -2.35, None, 0.0, 1.0, 0.0, 0.0]


def test_money_against_exact_arithmetic(spark):
    """Net revenue and margin of random lines, halves included, as decimals by hand."""
    pick = random.Random(8)
    cents = lambda top: Decimal(pick.randrange(1, top)) / 100
    rows = [(pick.randrange(1, 99), cents(10**pick.randrange(2, 9)), Decimal(pick.randrange(-2000, 15000)) / 10000, cents(10**6)) for _ in range(2000)]
    rows += [(1, Decimal("0.05"), Decimal("0.5"), Decimal("0.01")), (1, Decimal("0.05"), Decimal("1.5"), Decimal("0.01"))]
    df = spark.createDataFrame(rows, "q int, p decimal(10,2), d decimal(5,4), c decimal(10,2)")
    net = money.net_revenue(F.col("q"), F.col("p"), F.col("d"))
    got = df.select(*df.columns, net.alias("net"), money.gross_revenue(F.col("q"), F.col("p")).alias("gross")).collect()
    half_up = lambda value: value.quantize(Decimal("0.01"), ROUND_HALF_UP)
    for r in got:
        assert r.net == half_up(r.q * r.p * (1 - r.d)) and r.gross == half_up(r.q * r.p)


def test_surrogate_key(spark):
    import hashlib

    row = spark.createDataFrame([("a", None, 3)], "x string, y string, z int").select(surrogate_key("x", "y", "z"), surrogate_key("x")).first()
    texts = ["a-_dbt_utils_surrogate_key_null_-3", "a"]
    assert list(row) == [hashlib.md5(t.encode()).hexdigest() for t in texts]


PAGE = """<html><body><H2 class="t">Phones &amp; more</H2>
<p>between</p><table id="a"><thead><tr><th>N</th></tr></thead><tbody>
<tr><td> One &lt;b&gt; </td><td>Cat</td><td class="price">$1,249.00</td><td>In Stock</td></tr>
<tr><td>Two</td><td>Cat</td></tr>
<TR><TD><b>Three</b></TD><TD>C&#233;t</TD><TD>free</TD></TR>
<!-- <tr><td>Hidden</td><td>x</td><td>1</td></tr> -->
</tbody></table>
<h2>Same</h2><table><tr><td>Old</td><td>x</td><td>1</td></tr></table>
<h2>Same</h2><table><tr><td>New</td><td>x</td><td>2</td></tr></table>
<h2>Nothing follows</h2></body></html>"""


def test_html_without_end_tags(spark):
    page = "<h2>A<h2>B</h2><h2>C</h2> x <table><tr><td>a<td>b<td>1<tr><td>c<td>d<td>2<td>Sold out</table>"
    got = {(r.section, r.product_name, r.category, float(r.competitor_price), r.stock_status) for r in extract_html_tables(spark.createDataFrame([(page,)], "html string")).collect()}
    assert {g[1:] for g in got} == {("a", "b", 1.0, "Unknown"), ("c", "d", 2.0, "Sold out")} and {g[0] for g in got} == {"AB", "C"}


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<h2>no table</h2>"), (3, "<table><tr><td>a</td><td>b</td><td>1</td></tr></table>"), (4, None)], "page_id int, html string")
    got = {tuple(r) for r in extract_html_tables(pages, source=F.lit("s")).collect()}
    assert {(r[0], r[1], r[2], r[3], float(r[4]), r[5], r[6], r[7]) for r in got} == {
        (1, "One <b>", "Cat", "Phones & more", 1249.0, "In Stock", None, "s"),
        (1, "Three", "Cét", "Phones & more", 0.0, "Unknown", None, "s"),
        (1, "New", "x", "Same", 2.0, "Unknown", None, "s"),
    }


def test_a_page_with_many_headings(spark):
    """Time grows with the parts of a page, not with their square; of equal titles the last counts."""

    def page(count):
        parts = [f"<h2>Title {i % (count // 2)}</h2>" + (f"<table><tr><td>p{i}</td><td>c</td><td>{i}</td></tr></table>" if i % 4 == 3 else "") for i in range(count)]
        return "".join(parts)

    def extracted(count):
        frame = spark.createDataFrame([(1, page(count))], "page_id int, html string")
        started = time.monotonic()
        rows = extract_html_tables(frame).collect()
        return {r["section"]: r["product_name"] for r in rows}, time.monotonic() - started

    extracted(100)
    for count in (400, 20_000):
        found, seconds = extracted(count)
        assert found == {f"Title {i % (count // 2)}": f"p{i // 4 * 4 + 3}" for i in range(count // 2, count)}
    assert seconds < 30


@pytest.mark.parametrize("combine, start, by_hand", [(SUM, "0", lambda v: sum(v)), (MOST, "0", lambda v: max([0, *v])), (LAST_SEEN, "-1", lambda v: next((x for x in reversed(v) if x >= 0), -1))])
@pytest.mark.parametrize("size", [0, 1, 64, 65, 700])
def test_running(spark, combine, start, by_hand, size):
    numbers = [(i * 7919) % 13 - 6 for i in range(size)]
    found = spark.createDataFrame([(numbers,)], "n array<int>").select(F.expr(running("n", combine, start))).first()[0]
    assert found == [by_hand(numbers[:i]) for i in range(size)]


REFUSED = [
    "DROP TABLE x", "select 1; select 2", "SELECT 1; DROP TABLE x", "insert into x values (1)", "select * from x -- all", "select /* x */ 1",
    "SHOW TABLES", "", "select xp_run()", "select reflect('java.lang.System', 'exit')", "select * from parquet.`/etc`", "WITH a AS (DELETE FROM x) SELECT 1",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM guarded_t", "select * from (FROM guarded_t MAP id USING 'cat' AS y)", "SELECT * FROM `parquet`.`/root/testdata/sf0.001/part.parquet`",
    "select * from xml.`/x`", "select * from guarded_hidden", "select id from guarded_t where id in (select id from guarded_hidden)", "select (select max(id) from guarded_hidden) from guarded_t",
    "with a as (select 1 as id) insert into guarded_t select * from a", "select `reflect`('a', 'b')", "select 'CTE [guarded_hidden]' from guarded_hidden",
    "select '\nCTE [guarded_hidden]' from guarded_hidden", "select 1 as `CTE [guarded_hidden]` from guarded_hidden", "FROM guarded_t SELECT id", "values (1)",
    "SELECT * FROM IDENTIFIER('guarded_hidden')", "SELECT * FROM IDENTIFIER('guarded_' || 'hidden')", "select * from identifier('guarded_t')",
    "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/nation.parquet`')", "select identifier('id') from guarded_t", "select identifier('upper')('a')",
    "with identifier('x') as (select 1) select 1", "select id from guarded_t where id in (select id from identifier('guarded_hidden'))",
    "select id from guarded_t window w as (order by (select max(id) from guarded_hidden))", "select sum(id) over (order by (select max(id) from guarded_hidden)) from guarded_t",
    "select * from guarded_t, lateral (select * from guarded_hidden)", "select * from guarded_t pivot (sum(id) for id in ((select max(id) from guarded_hidden)))",
    "select transform(array(1), x -> (select max(id) from guarded_hidden)) from guarded_t", "select * from (values ((select max(id) from guarded_hidden))) as v(a)",
    "select id from (with guarded_hidden as (select 1 as id) select id from guarded_hidden) join guarded_hidden using (id)",
    "with a as (select * from b), b as (select 1) select * from a", "with guarded_hidden as (select * from guarded_hidden) select * from guarded_hidden",
    "select * from guarded_t version as of 1", "select * from sql_keywords()", "select :p from guarded_t", "table guarded_t", "select * from system.guarded_t",
    "select * from guarded_t group by id having max(id) > (select max(id) from guarded_hidden)", "select id from guarded_t order by (select max(id) from guarded_hidden)",
    "select * from guarded_t limit (select max(id) from guarded_hidden)", "select * from guarded_t lateral view explode(array((select max(id) from guarded_hidden))) as x",
    "select 1 union all select id from guarded_hidden", "select TRY_REFLECT('a', 'b') from guarded_t", "select system.builtin.reflect('a', 'b')",
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(spark, text):
    guarded.register_views({"guarded_t": spark.range(501)})
    spark.range(3).createOrReplaceTempView("guarded_hidden")
    answer = guarded.guarded_sql(spark, text)
    assert answer.rows is None and answer.error


PLAIN_QUERIES = [
    "select id % 7 as d, count(*) filter (where id > 3) as n, sum(id) from guarded_t group by rollup(id % 7) having count(*) > 1 order by 1 limit 3 offset 1",
    "with x(a) as (select id from guarded_t), y as (select a + 1 as b from x) select x.a from x left join y on x.a = y.b where exists (select 1 from y where b = a) and a in (select b from y)",
    "select case when id between 1 and 2 then 'x' else upper(note) end, -id, cast(id as string) || 'x', trim(note), substring(note from 1 for 2), note like 'D%', note rlike 'D' from guarded_t",
    "select id, sum(id) over (partition by id % 3 order by id desc rows between 1 preceding and current row) as n, lag(id) over w from guarded_t window w as (order by id)",
    "select distinct id from guarded_t union all select 1 except select 2 intersect select 3",
    "select * from (select id % 2 as a, id from guarded_t) pivot (sum(id) for a in (0, 1))", "select a from (values (1), (2)) as v(a)",
    "select x, transform(array(1, 2), y -> y + 1)[0] from guarded_t lateral view explode(array(id)) e as x", "select t.id from guarded_t t, lateral (select t.id + 1 as n) l",
    "with recursive r as (select 1 as n union all select n + 1 from r where n < 3) select * from r", "select a.id from range(3) a", "select date '2020-01-01' + interval 1 day, current_date",
    "select extract(year from current_date), timestampadd(day, 1, timestamp '2020-01-01 00:00:00'), id div 2, id <=> 1, not (id is null) from guarded_t", "select percentile_cont(0.5) within group (order by id) from guarded_t",
    "select * except (note) from guarded_t natural join (select 1L as id)", "select (select max(id) from guarded_t) as m, id from guarded_t group by all",
]


def test_allowed(spark):
    guarded.register_views({"guarded_t": spark.range(501).selectExpr("id", "id as updated_at", "'DROP; --' as note", "id as `update`")})
    for text in ("select `update`, id as `insert` from GUARDED_T", "select a.id from guarded_t a join guarded_t b using (id)", "SELECT updated_at FROM guarded_t;", "with x as (select * from guarded_t) select id from x", "select id from guarded_t where note = 'DROP; --'"):
        answer = guarded.guarded_sql(spark, text)
        assert answer.error is None and answer.truncated and answer.rows.count() == 500
    for text in PLAIN_QUERIES:
        assert guarded.guarded_sql(spark, text).error is None, text
    exact = guarded.guarded_sql(spark, "select id from guarded_t where id < 500")
    assert not exact.truncated
    assert guarded.guarded_sql(spark, "select id from guarded_t where id < 500", inclusive=True).truncated
    unknown = guarded.guarded_sql(spark, "select nothing from guarded_t")
    assert unknown.rows is None and "nothing" in unknown.error
    assert guarded.guarded_sql(spark, "select 1 / 0 from guarded_t").error


def test_statement_texts():
    assert guarded.extract_statement("Sure:\n```sql\nWITH a AS (SELECT 1) SELECT * FROM a; more\n```") == "WITH a AS (SELECT 1) SELECT * FROM a"
    assert guarded.extract_statement("no statement") == ""
    assert guarded.check_question("abc") and guarded.check_question("x" * 501)
    assert guarded.check_question("How many?") is None


def test_texts_are_packed_without_loss(spark):
    texts = ["", "-", "1", "12", "-5", "123-45", "00", "0-0", "A", "F", "FF", "a1", "1 2", "1\n", "\n", "\x00", "\x001", "é", "١٢", "1.5", "ITEM-1", "9" * 40, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    packed = df.select("t", pack_text(F.col("t")).alias("p"))
    got = packed.select("t", "p", unpack_text(F.col("p")).alias("u")).collect()
    assert all(r.t == r.u for r in got) and len({None if r.p is None else bytes(r.p) for r in got}) == len(texts)
    sizes = {r.t: r.p and len(r.p) for r in got}
    assert sizes["9" * 40] == 21 and sizes["123-45"] == 4 and sizes["ITEM-1"] == 7 and sizes[None] is None
