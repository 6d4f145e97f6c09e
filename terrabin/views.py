"""Tables derived from the driver's ones, as one SQL text for Spark and DuckDB: pixels, strata, rules, species, records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from terrabin.shipping import tasks

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _px(hint: str = "") -> str:
    return f"""select {hint}cast(o_orderkey % 150 as bigint) as x, cast(floor(o_orderkey/150.0) as bigint) as y,
  cast(o_custkey % 16 as bigint) as cover,
  case when o_orderpriority='1-URGENT' then null else o_totalprice/150.0 end as height,
  cast(floor(o_custkey/16.0) as bigint) % 6 as veg,
  cast(o_custkey % 4 as bigint) as wb, cast(o_orderkey % 7 % 4 as bigint) as bb,
  cast(floor(o_orderkey/3.0) as bigint) % 4 as eb, cast(floor(o_orderkey/5.0) as bigint) % 4 as rb,
  cast(floor(o_orderkey/11.0) as bigint) % 4 as cb, cast(floor(o_custkey/3.0) as bigint) % 4 as vb,
  cast(c_nationkey + 1 as bigint) as pref, cast(n_regionkey as bigint) as region
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""


def _cell(hint: str = "") -> str:
    return f"""select gx, gy, pref, region, cover, h, alt, veg, wb, bb, eb, rb, cb, vb,
  bb + 4*wb + 16*h + 64*cover + 1024*cb + 4096*eb + 16384*rb + 65536*vb + 262144*veg as k, count(*) as n
from (select {hint}*, 12000 + cast(floor(x/5.0) as bigint) as gx, 15000 + cast(floor(y/5.0) as bigint) as gy,
  cast(case when height is null then 3 when height < 200 then 0 when height < 800 then 1 else 2 end as bigint) as h,
  cast(case when height is null then 31 when height >= 3000 then 30 else cast(floor(height/100.0) as bigint) end as bigint) as alt from px) q
group by gx, gy, pref, region, cover, h, alt, veg, wb, bb, eb, rb, cb, vb"""


def _records(hint: str = "", joined: str = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey") -> str:
    return f"""select {hint}l_suppkey as species_id, cast(c_nationkey + 1 as bigint) as pref,
  case when l_linenumber = 1 then 'mainland' when l_linenumber = 7 then '' else concat('isl', cast(l_linenumber as varchar(10))) end as island,
  case when l_returnflag = 'R' then 'suspect' else 'normal' end as record_accuracy
from {joined}"""


VIEWS = {
    "px": _px(),
    "cell": _cell(),
    "rules": """select cast(species_id as bigint) as species_id, rule_id, class_mask, base_mask, water, built, edge, rice, coast, river, veg, elev_mask, elev_required, supported from (values
  (1,'H001',  32,  32, true,false,false,false,false,false,0, 15,false,true),
  (1,'H002', 960, 960,false,false, true,false,false,false,0,  4, true,true),
  (2,'H003',  96,  64,false, true,false,false,false,false,0, 15,false,true),
  (2,'H004', 960, 960,false,false,false,false,false,false,2, 15,false,true),
  (3,'H005',2048,2048,false,false,false, true,false,false,0,  3, true,true),
  (4,'H006',   0,   0,false,false,false,false,false,false,0, 15,false,false),
  (5,'H001',  32,  32, true,false,false,false,false,false,0, 15,false,true),
  (5,'H006',   0,   0,false,false,false,false,false,false,0, 15,false,false))
 as t(species_id, rule_id, class_mask, base_mask, water, built, edge, rice, coast, river, veg, elev_mask, elev_required, supported)""",
    "species": "select s_suppkey as species_id, s_name as name, concat('genus', cast(s_nationkey as varchar(10))) as genus from supplier",
    "records": _records(),
    "rules_all": """select * from rules union all select * from (values
  (6,'H007', 960, 960,false,false,false,false,true ,false,0, 15,false,true),
  (6,'H008',  32,  32,false,false,false,false,false,true ,0,  7,false,true),
  (7,'H009',  96,  96,true ,false,false,false,false,true ,0, 15,false,true),
  (7,'H001',  32,  32,true ,false,false,false,false,false,0, 15,false,true))
 as t(species_id, rule_id, class_mask, base_mask, water, built, edge, rice, coast, river, veg, elev_mask, elev_required, supported)""",
    # rules of every supplier as a species: the conditions of a habitat are a lookup table, four sets of them occur
    "habitat": """select cast(s_suppkey as bigint) as species_id, rule_id, class_mask, base_mask, water, built, edge, rice, coast, river, veg, elev_mask, elev_required, supported
from supplier join (values (0,'H101',  32,  32, true,false,false,false,false,false,0, 15,false,true), (1,'H102', 960, 960,false,false, true,false,false,false,0,  4, true,true),
  (2,'H103',  96,  64,false, true,false,false,false,false,0, 15,false,true), (3,'H104', 960, 960,false,false,false,false,false,false,2, 15,false,true),
  (4,'H105',2048,2048,false,false,false, true,false,false,0,  3, true,true), (5,'H106',   0,   0,false,false,false,false,false,false,0, 15,false,false),
  (6,'H107', 960, 960,false,false,false,false,true ,false,0, 15,false,true), (7,'H108',  24,   8,false,false,false, true,false,true ,0,  7,false,true))
 as t(id, rule_id, class_mask, base_mask, water, built, edge, rice, coast, river, veg, elev_mask, elev_required, supported) on (s_suppkey % 4 * 3 + id * 5) % 8 < 2""",
    "cell_region": "select gx, gy, pref, case when gx % 4 = 0 then 0 else pref*10 + gx % 4 end as rid from cell group by gx, gy, pref",
    "island_alias": """select concat('isl', cast(i as varchar(10))) as island, pref, pref*10 + i as rid
from (select distinct pref from cell) p cross join (values (2),(3)) as t(i)""",
    # stars of twelve corners around suppliers, in pixels; every third has a hole of a quarter of its size
    "corner": """select s_suppkey as poly, cast(s_nationkey + 1 as bigint) as pref, ring, i, s_suppkey * 37 % 150 + 25e-2 + dx * (4 + s_suppkey % 13) * (1 - (s_suppkey + i) % 3 * 25e-2) * part as px,
  s_suppkey + s_suppkey % 7 * 125e-3 + dy * (4 + s_suppkey % 13) * (1 - (s_suppkey + i) % 3 * 25e-2) * part as py
from supplier cross join (values (0, 1e0, 0e0), (1, 875e-3, 5e-1), (2, 5e-1, 875e-3), (3, 0e0, 1e0), (4, -5e-1, 875e-3), (5, -875e-3, 5e-1),
  (6, -1e0, 0e0), (7, -875e-3, -5e-1), (8, -5e-1, -875e-3), (9, 0e0, -1e0), (10, 5e-1, -875e-3), (11, 875e-3, -5e-1)) as d(i, dx, dy)
join (values (0, 1e0), (1, 25e-2)) as h(ring, part) on ring = 0 or s_suppkey % 3 = 0""",
    "shape": """select cast(a.poly as bigint) as poly, a.pref, cast(a.ring as bigint) as ring, cast(a.i as bigint) as seq, a.px as x1, a.py as y1, b.px as x2, b.py as y2
from corner a join corner b on b.poly = a.poly and b.ring = a.ring and b.i = (a.i + 1) % 12""",
    # coast lines of three segments, long and thin
    "coast": """select cast(s_suppkey as bigint) as line, cast(i as bigint) as seq, s_suppkey * 11 % 150 + ax as x1, s_suppkey * 7 % 200 / 2e0 + ay as y1, s_suppkey * 11 % 150 + bx as x2, s_suppkey * 7 % 200 / 2e0 + by1 as y2
from supplier cross join (values (0, 0e0, 0e0, 40625e-3, 3125e-3), (1, 40625e-3, 3125e-3, 75125e-3, 30375e-3), (2, 75125e-3, 30375e-3, 75875e-3, 61e0)) as d(i, ax, ay, bx, by1) where s_suppkey % 4 = 0""",
    # descriptions: a lookup table of words, and every part's own, of one or of two of them
    "words_ja": """select cast(n as bigint) as n, label from (values (1,'水辺'),(2,'林縁'),(3,'草原'),(4,'竹林'),(5,'山地の森林'),(6,'水田の畦'),(7,'耕作地'),(8,'湿原'),
  (9,'裸地'),(10,'公園の緑地'),(11,'里山'),(12,'砂浜'),(13,'市街地'),(14,'洞窟'),(15,'河口'),(16,'海岸~低山地の森林'),(17,'倉庫'),(18,'良い林'),(19,'樹上'),(20,'果樹園'),
  (21,'人家の周囲'),(22,'河川敷'),(23,'水田の周囲'),(24,'牧草地'),(25,'山地'),(26,'低山地の草地'),(27,'植林地'),(28,'海浜'),(29,'市街地の草地'),(30,'ハイマツ帯'),(31,'薮'),(32,'旧家')) as t(n, label)""",
    "labels_ja": """select cast(p_partkey as bigint) as n, case when p_partkey % 5 = 0 then concat(a.label, 'の', b.label) else a.label end as label
from part join words_ja a on a.n = p_partkey % 32 + 1 join words_ja b on b.n = p_partkey * 7 % 31 + 1""",
}
_NEEDS = {v: [b for b in [*BASE, *VIEWS] if b != v and re.search(rf"\b(from|join)\s+{b}\b", text)] for v, text in VIEWS.items()}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(v: str) -> None:
        for x in _NEEDS.get(v, []):
            visit(x)
        if v not in out:
            out.append(v)

    for n in names:
        visit(n)
    return out


def ctes(*names: str) -> str:
    """The views' definitions, for a WITH clause over the driver's tables."""
    return ",\n".join(f"{v} as ({VIEWS[v]})" for v in _closure(names) if v in VIEWS)


def sql(body: str, *names: str) -> str:
    """A statement over views: body may start with further definitions, introduced by 'with'."""
    head = ctes(*names)
    rest = body.strip()
    if rest.startswith("with "):
        return f"with {head},\n{rest[5:]}" if head else rest
    return f"with {head}\n{rest}" if head else rest


#: Pixels of a task that counts cells: it holds them in several tables at once.
CELL_ROWS = 200_000


def _dealt(cells: int, lines: int) -> dict[str, str]:
    """Views in tasks of bounded rows: cells are counted, and records found, in so many tasks (0: as the session has it).
    Customers grow with the tables and are not broadcast; orders meet them before the lines do, so that lines are dealt
    twice only, to their orders and to their species."""
    out = {}
    if cells:
        out |= {"px": _px("/*+ merge(customer) */ "), "cell": _cell(f"/*+ repartition({cells}, gx, gy, pref) */ ")}
    if lines:
        placed = f"(select /*+ merge(customer), repartition({lines}, o_orderkey) */ o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey) o"
        out["records"] = _records(f"/*+ repartition({lines}, species_id, pref) */ ", f"lineitem join {placed} on l_orderkey = o_orderkey")
    return out


_COUNTED: dict[tuple[str, str], int] = {}


def _rows(spark: SparkSession, path: str) -> int:
    """Rows of a table, from its files' footers, once a session: they only decide how many tasks there are."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _COUNTED:
        _COUNTED[key] = spark.read.parquet(path).count()
    return _COUNTED[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needed = _closure([name])
    rows = lambda table, *users: _rows(spark, f"{sf_dir}/{table}.parquet") if any(u in needed for u in users) else 0
    orders, lines = rows("orders", "cell", "records"), tasks(spark, rows("lineitem", "records"))
    text = VIEWS | _dealt(tasks(spark, orders, CELL_ROWS) if "cell" in needed else 0, lines)
    n = tasks(spark, orders)
    hint = {"orders": f"/*+ repartition({n}, o_custkey) */ "} if n else {}
    bases = [f"{b} as (select {hint.get(b, '')}* from parquet.`{sf_dir}/{b}.parquet`)" for b in needed if b in BASE]
    own = [f"{v} as ({text[v]})" for v in needed if v in VIEWS]
    return spark.sql(f"with {', '.join([*bases, *own])} select * from {name}")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
