"""Queries over habitat descriptions, and from descriptions through rules to areas, with SQL of their own patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrabin.catalogue import BIG, _b, query
from terrabin.functions import text
from terrabin.operators import labels, policy, predicate, summary
from terrabin.settings import QuerySettings
from terrabin.views import base


def _list(*parts: tuple[str, str]) -> str:
    return "flatten([" + ", ".join(f"case when {c} then [{v}] else [] end" for c, v in parts) + "])"


def _re(pattern: str) -> str:
    return f"regexp_matches(s, '{pattern}')"


_LAND, _GREEN = "[2,3,4,5,6,7,8,9,10,11,13,15]", "[5,6,7,8,9,11]"
_NOT2 = "[3,4,5,6,7,8,9,10,11,13,15]"
_URBAN = "s in ('市街地', '都市部', '都市部~市街地', '平地の市街地', '市街地の人工的な環境', '建造物', '市街地の建造物', '人家', '市街地の人家')"
_WOODS = "森林|樹林|林地|社寺林|寺社林|造林地|植林地|(の|^|い)林$"
#: classify and spatial_rule step by step: b has a description's words and base classes, r2..r9 its classes after each step.
_RULES = f"""b as (select n, label as s, label,
  {_re('洞窟|暗所|建造物.*内|建物|倉庫|畜舎|物置|石垣|岩の間').replace('(s,', '(label,')} as indoor,
  regexp_matches(label, '平地|低山|山地|高山|高地|高原|丘陵|亜高山|寒冷') as climate from labels_ja),
c1 as (select *, case when indoor then [] else list_sort(list_distinct({_list((_re('竹林'), '11'), (f"not contains(s, '竹林') and {_re(_WOODS)}", '6,7,8,9'), (_re('草原|草地|草むら|芝生|牧草地'), '5'), ("contains(s, '水田') and not contains(s, '畦')", '3'), (_re('耕作地|農耕地'), '3,4'), (_re('湿地|湿原'), '13'), ("contains(s, '裸地')", '10'), (_URBAN, '2'))})) end as base,
  list_sort({_list(('climate', "'標高・気候'"), (_re('水辺|川辺|渓流|河川|河原|河口|沼沢|海岸|海浜|海辺|港湾|湖沼'), "'水際・海岸への距離'"), (_re('林縁|落葉層|薮|藪|植えこみ|ハイマツ'), "'微環境・植生構造'"), ("contains(s, '水田') and contains(s, '畦')", "'水田の畦'"), (_re('公園|庭|緑地|空き地|街路樹|寺社|社寺'), "'公園・庭・緑地の位置'"), (_re('里山|人里'), "'里山の環境構成'"), (_re('岩場|崖地|砂浜|潮間帯|果樹園|乾燥地|荒地|荒れ地'), "'土地被覆で識別できない環境'"), (_URBAN, "'建物内外の環境'"))}) as w0 from b),
c2 as (select *, case when indoor then case when climate then ['屋内・洞窟・隙間', '標高・気候'] else ['屋内・洞窟・隙間'] end when len(base) = 0 and len(w0) = 0 then ['土地被覆への対応'] else w0 end as wait,
  {_re('海岸[~〜～]')} as coast_range, {_re('海岸|海浜|海辺|港湾')} as shore, contains(s, '水辺') as water, {_re('川|河|渓流|沼沢|湖沼')} as specific,
  {_re('川辺|河原|河川')} and not {_re('渓流|河口')} as river,
  case when contains(s, '果樹園') then 1 when {_re('植林|造林')} then 2 when contains(s, '牧草') then 3 when s = 'ハイマツ帯' then 4 when contains(s, '薮') then 5 else 0 end as vegetation,
  contains(s, '林縁') as edge, {_re('水田.*(周囲|畦)')} as rice, {_re('市街地|都市|人家|建造物|建物')} as urban, {_re('公園|庭|緑地|空き地|街路樹|寺社|社寺')} as managed, {_re('(人家|建造物).*周囲')} as around,
  {_re('平地|低地')} or {_re('海岸[~〜～]')} as low, {_re('低山|丘陵')} as middle, regexp_matches(replace(s, '低山地', '低山'), '山地|高山|高地|高原|亜高山') as high from c1),
k as (select *, low or middle or high as banded, shore and not coast_range as coast, contains(s, '畦') as ridge,
  case when indoor then [] when {_re('水田.*(周囲|畦)')} then case when contains(s, '畦') then [5] else {_NOT2} end
    when vegetation in (4, 5) then {_GREEN} when vegetation = 3 then [5] when vegetation = 2 then [6,7,8,9] when vegetation = 1 then [5,6,7,8,9,11,4]
    when river then case when contains(s, '河川敷') then [5] when contains(s, '河原') then [5,10,15] else {_LAND} end
    when {_re('草原|草地|草むら|芝生')} then [5] when {_re('森林|樹林|林地|寺社林|社寺林|緑地林|植林地|造林地|(^|の)(良い)?林($|の)')} then [6,7,8,9]
    when len(base) > 0 then base when edge then {_NOT2} when (shore and not coast_range) or water or around then {_LAND} when managed then {_GREEN}
    when low or middle or high then {_LAND} else [] end as whole from c2),
r9 as (select *, case when around then list_filter(whole, lambda x: x <> 2) else whole end as cand from k),
r10 as (select *, urban and len(cand) > 0 and cand <> [2] as town, managed or around or (urban and len(cand) > 0 and cand <> [2]) or (urban and len(list_filter(base, lambda x: x <> 2)) > 0) as built,
  flatten([list_filter(wait, lambda x: x not in ('水際・海岸への距離', '公園・庭・緑地の位置', '標高・気候', '土地被覆への対応', '建物内外の環境') and not (x = '微環境・植生構造' and edge) and not (x in ('微環境・植生構造', '土地被覆で識別できない環境') and vegetation > 0) and not (x = '水田の畦' and rice)),
    {_list(('specific and not river', "'河川・湖沼・沼沢の種類や範囲（汎用の水域で代用しない）'"), (_re('里山|人里'), "'里山・人里の土地利用の構成と範囲'"), ("contains(s, '良い林')", "'林の質・植生構造'"), ("contains(s, '街路樹')", "'道路沿いの樹木の位置'"), ("contains(s, '旧家')", "'建物の年代'"), ("contains(s, '港湾')", "'港湾の区域'"), ("contains(s, '潮間帯')", "'潮位・干出範囲'"), (_re('砂浜|岩場|岩礁'), "'砂・岩などの底質区分'"), ("contains(s, '島嶼')", "'環境条件としての島嶼限定'"), ("s in ('亜高山帯', '高山帯', '寒冷地')", "'気候・植生帯の地域差'"), ('len(cand) = 0', "'土地被覆への対応'"))}]) as open,
  {_list(('river', "'河川中心線への近さで近似。河川敷の堤防・冠水域や河岸線は識別せず、幅の広い河川では岸を取りこぼす場合がある'"), ('vegetation > 0', "'現存植生図2024の凡例と土地被覆を重ねた近似。調査年代・縮尺が異なり、小面積の植生や現在の管理状態を保証しない'"), ('vegetation = 4', "'ハイマツ群落の記載範囲を使用し、気候帯全体を表すものではない'"), ('vegetation = 5', "'薮は植生図の低木群落・落葉広葉低木群落で近似し、林内の下層植生は識別しない'"), ("rice and contains(s, '畦')", "'畦の幅・形状は識別せず、水田に近い草地で近似'"), ("rice and not contains(s, '畦')", "'周囲は水田から指定距離以内の陸地'"), ('managed', "'公園・庭・寺社等の敷地を識別せず、人工構造物に近い植生で近似'"), ('around', "'人工構造物自体を除いた周辺の陸地。建物の用途・敷地境界は識別しない'"), ('edge', "'林縁は森林・竹林と他の既知の土地被覆の境界で近似'"), ('banded', "'標高条件は未実装のため、平地・山地等の高さによる限定はしていない'"), ('coast_range', "'海岸から低山地までの広い範囲の記述として扱い、海岸への距離では限定しない'"), ('town', "'市街地・集落の区域を識別せず、人工構造物への近さで近似'"), ("contains(s, '芝生')", "'草地の管理状態や芝の種類は識別しない'"), ("contains(s, '湿原')", "'湿地の土地被覆で近似し、湿原の植生・泥炭・水文条件は識別しない'"), ("s = '海浜'", "'海岸線に近い陸地で近似し、砂浜や礫浜の底質は識別しない'"), ('cand = [2]', "'人工構造物の土地被覆で近似し、建物の用途や内部は識別しない'"))} as limits from r9),
ru as (select n, label, base, case when len(open) > 0 then [] else cand end as classes, cand, water, coast, built, edge, rice, river, vegetation,
  case when banded then generate_series(case when low then 0 when middle then 1 else 2 end, case when high then 2 when middle then 1 else 0 end) else [0,1,2,3] end as elevation,
  len(open) = 0 as supported, list_distinct(open) as pending, open, limits from r10)"""
RULES, WORDS = _RULES, _RULES.replace("from labels_ja", "from words_ja")
_TEXTS = "array_to_string(list_filter(open, lambda x, i: list_position(open, x) = i), ',')"


@query("F5_spatial_rule", f"""with {RULES}
select n, label, array_to_string(classes, ',') as classes, array_to_string(cand, ',') as candidate_classes, water, coast, built, edge, rice, river, cast(vegetation as bigint) as vegetation, array_to_string(elevation, ',') as elevation, supported,
  {_TEXTS} as pending, array_to_string(limits, ',') as limitations, len(limits) > 0 as proxy from ru""", "labels_ja")  # fmt: skip
def _(labels_ja):
    join = lambda c: F.array_join(F.col(c), ",").alias(c)
    return labels.spatial_rules(labels_ja).select("n", "label", join("classes"), join("candidate_classes"), "water", "coast", "built", "edge", "rice", "river", _b("vegetation"), join("elevation"), "supported", join("pending"), join("limitations"), "proxy")


def _mask(c: str) -> str:
    return f"cast(coalesce(list_sum(list_transform({c}, lambda x: cast(1 as bigint) << cast(x as int))), 0) as bigint)"


#: Descriptions of species: some twice, which count once.
_HABITATS = "hab as (select species_id, n from species cross join words_ja where (species_id * 7 + n) % 13 = 0 union all select species_id, n from species cross join words_ja where (species_id * 7 + n) % 26 = 0)"
_SPECIES_RULES = f"""{WORDS}, {_HABITATS},
sr as (select distinct species_id, concat('H', n) as rule_id, {_mask('classes')} as class_mask, {_mask('base')} as base_mask, water, built, edge, rice, coast, river, cast(vegetation as bigint) as veg, {_mask('elevation')} as elev_mask, supported from hab join ru using (n))"""


def _species_rules(species: DataFrame, words_ja: DataFrame) -> DataFrame:
    pairs = species.select("species_id").crossJoin(F.broadcast(words_ja))  # 32 descriptions
    hash_ = F.col("species_id") * 7 + F.col("n")
    habitats = pairs.where(hash_ % 13 == 0).unionByName(pairs.where(hash_ % 26 == 0))
    return labels.species_rules(habitats.select("species_id", F.concat(F.lit("H"), F.col("n").cast("string")).alias("rule_id"), "label"))


@query("J3_species_rules", f"with {_SPECIES_RULES} select * from sr", "species", "words_ja")
def _(species, words_ja):
    return _species_rules(species, words_ja).drop("elev_required", "pending", "limitations", "proxy")


@query("P23_of_descriptions", f"""with {_SPECIES_RULES}
select distinct species_id, concat('H', n) as rule_id, case when not supported then 'unavailable' when len(list_filter(classes, lambda x: x <> 5)) = 0 then 'excluded_landcover' when len(limits) > 0 then 'proxy' else 'calculated' end as evaluation,
  cast(case when supported and coast then 500 end as bigint) as coast_m, cast(case when supported and river then 500 end as bigint) as river_m, array_to_string(elevation, ',') as elevation_bands, {_TEXTS} as unresolved, array_to_string(limits, ',') as limitations from hab join ru using (n)""", "species", "words_ja")  # fmt: skip
def _(species, words_ja):
    told = policy.metadata(_species_rules(species, words_ja), QuerySettings(excluded=(5,)))
    return told.select("species_id", "rule_id", "evaluation", "coast_m", "river_m", "elevation_bands", "unresolved", "limitations")


@query("J3_areas_of_descriptions", f"""with {_SPECIES_RULES.replace('sr as (', 'sr as materialized (')},
hit as (select distinct q.species_id, c.gx, c.gy, c.pref, c.k, c.alt, c.n from sr q join cell c on q.supported and c.cover > 0 and ((q.class_mask >> cast(c.cover as int)) & 1) = 1
  and {' and '.join(f'(not q.{f} or c.{d} <= 2)' for f, d in predicate.NEAR)} and (q.veg = 0 or q.veg = c.veg) and ((q.elev_mask >> cast(c.h as int)) & 1) = 1)
select species_id, pref, cast(sum(n) as bigint) as pixels from hit group by 1, 2""", "species", "words_ja", "cell")  # fmt: skip
def _(species, words_ja, cell):
    rules = _species_rules(species, words_ja)
    return summary.area_by_pref(cell, rules, QuerySettings(model="elevation")).select("species_id", "pref", _b("pixels"))


@query("P1_norm", "select page_id, trim(regexp_replace(url, '\\s+', ' ', 'g')) as url, 'ABC 123 1' as fixed from pages")
def _(spark, sf_dir):
    return base(spark, sf_dir, "pages").select("page_id", text.norm(F.col("url")).alias("url"), text.norm(F.lit("ＡＢＣ　 １２３\n①")).alias("fixed"))


_SCIENTIFIC = "case species_id % 7 when 0 then concat('Araneus alba minor (L., 17', species_id, ')') when 1 then 'Araneus alba van Hasselt' when 2 then 'Pardosa sp. A' when 3 then 'Pardosa t-insignita' when 4 then 'unnamed spider' when 5 then 'Araneus alba vanessa' else concat('Lycosa  cf. ', species_id) end"
#: What the fixed pattern says, in steps: DuckDB's patterns look neither ahead nor behind.
_BINOMIAL = f"""with l as (select species_id, regexp_replace({_SCIENTIFIC}, '\\s+', ' ', 'g') as s from species),
w as (select *, string_split(s, ' ') as w from l),
k as (select *, regexp_matches(w[1], '^[A-Z][a-z]+$') and (regexp_matches(w[2], '^[a-z][a-z-]+$') or w[2] = 'sp.') as two, coalesce(regexp_matches(w[3], '^[a-z][a-z-]+$') and w[3] not in ('van', 'von', 'de', 'del', 'da'), false) as three from w)
select species_id, case when two and three then concat(w[1], ' ', w[2], ' ', w[3]) when two then concat(w[1], ' ', w[2]) else s end as key from k"""


@query("P2_scientific_key", _BINOMIAL, "species")
def _(species):
    s, n = F.col("species_id"), F.col("species_id").cast("string")
    label = F.when(s % 7 == 0, F.concat(F.lit("Araneus alba minor (L., 17"), n, F.lit(")"))).when(s % 7 == 1, "Araneus alba van Hasselt").when(s % 7 == 2, "Pardosa sp. A")
    label = label.when(s % 7 == 3, "Pardosa t-insignita").when(s % 7 == 4, "unnamed spider").when(s % 7 == 5, "Araneus alba vanessa").otherwise(F.concat(F.lit("Lycosa  cf. "), n))
    return species.select("species_id", text.scientific_key(text.norm(label)).alias("key"))


@query("O5_label_order", "select n, cast(row_number() over (order by label collate ja, n) as bigint) as place from labels_ja", "labels_ja")
def _(labels_ja):
    from pyspark.sql import Window

    # a row a distinct description is numbered as a whole, its repeats within it
    counts = labels_ja.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    first = counts.select("label", (F.sum("k").over(Window.orderBy(F.collate("label", "ja"), "label")) - F.col("k")).alias("first"))
    return labels_ja.join(first, "label").select("n", (F.col("first") + F.row_number().over(Window.partitionBy("label").orderBy("n"))).cast(BIG).alias("place"))


for _name, _limit, _model in (("F7_coast_and_river", 2, "distance"), ("F7_coast_and_river_100", 0, "distance"), ("F7_coast_and_river_cover", 2, "cover")):
    _near = " and ".join(f"(not q.{f} or c.{d} <= {_limit})" for f, d in predicate.NEAR)
    _how = f"((q.class_mask >> cast(c.cover as int)) & 1) = 1 and {_near} and (q.veg = 0 or q.veg = c.veg)" if _model == "distance" else "((q.base_mask >> cast(c.cover as int)) & 1) = 1"

    @query(_name, f"""select s.species_id, c.pref, cast(sum(n) as bigint) as pixels from (select distinct species_id from rules_all) s cross join cell c where c.cover > 0 and exists (select 1 from rules_all q where q.species_id = s.species_id and q.supported
  and {_how} and (not q.elev_required or ((q.elev_mask >> cast(c.h as int)) & 1) = 1)) group by 1, 2""", "cell", "rules_all")  # fmt: skip
    def _(cell, rules_all, settings=QuerySettings(model=_model, distance=(100, 250, 500)[_limit])):
        return summary.area_by_pref(cell, rules_all, settings).select("species_id", "pref", _b("pixels"))


@query("G1_hold_of_coast_and_river", "select species_id, rule_id, array_to_string(list_filter([case when coast then 'coast' end, case when (elev_mask & 15) <> 15 then 'height' end, case when river then 'river' end], lambda x: x is not null), ',') as hold, supported and not coast and not river and (elev_mask & 15) = 15 as supported from habitat", "habitat")
def _(habitat):
    return policy.publication_rules(habitat).select("species_id", "rule_id", "hold", "supported")
