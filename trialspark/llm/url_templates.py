"""URL filtering by a path-template tree per host.

Paths are cut into segments, and segments of digits, hex or dates are named by their class; a brace in a literal is
doubled, so no literal can be taken for a class. Distinct shapes of a host are counted once, with their labelled pages;
all that follows works on these counts. Level by level from the root, the literal children of a node that have fewer
than MIN_LABELLED labelled pages, however many, become one wildcard, unless there is just one. The others are put into RANGES ranges by their
labelled bad share; from the least range on, a two-proportion test compares each range with the pooled run before it,
and what it cannot tell apart is one branch. A branch that one shape is left in is a leaf; others go on to the end of
their paths. Each branch's share of bad pages is smoothed towards its parent's, from the whole table down through the
host, and a template is rejected if it is above THRESHOLD. A host without a labelled page has no purity, and nothing of
it is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import columns_but, fresh, joined_copies, stored

#: Labelled pages that a child needs to stay a literal, ranges of the bad share, and the greatest |z| at which ranges merge.
MIN_LABELLED, RANGES, MAX_Z = 5, 20, 1.0
#: Weight of the parent's share in pages, and the smoothed share of bad pages above which a template is rejected.
PRIOR, THRESHOLD = 10.0, 0.5
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first "://" with A-Z lower-cased, the path up to ? or #; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, LETTERS, LETTERS.lower()), path


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules ("host/path" -> allow or block) that fits; null where none does.

    A rule fits its host and its subdomains where the path starts with the rule's. The list is a parameter of a few
    entries, so it is tried rule by rule inside one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=len):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments: classes of variable ones in braces, with a file ending; literals with braces doubled."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    ending = r"\.[A-Za-z0-9]{1,5}$"

    def named(x: Column) -> Column:
        s = F.regexp_replace(x, ending, "")
        kind = (
            F.when(s.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), "{date}")
            .when(s.rlike(r"^\d+$"), "{number}")
            .when(s.rlike(r"^[0-9a-fA-F-]{8,}$") & s.rlike(r"\d"), "{hex}")
            .when(F.length(s) > 40, "{long}")
        )
        return F.when(kind.isNull(), F.replace(x, F.lit("{"), F.lit("{{"))).otherwise(F.concat(kind, F.regexp_extract(x, ending, 0)))

    return F.transform(parts, named)


def merged_ranges(ranges: Column) -> Column:
    """array<struct<range,run>> of an array of structs (range, n, b), at most RANGES, with labelled and bad pages.

    run is the least range of the branch that a range belongs to.
    """
    kind = "struct<n:bigint,b:bigint,run:int,out:array<struct<range:int,run:int>>>"

    def step(a: Column, x: Column) -> Column:
        n, b = a["n"] + x["n"], a["b"] + x["b"]
        p = b / n
        z = F.abs(a["b"] / a["n"] - x["b"] / x["n"]) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (F.lit(1.0) / a["n"] + F.lit(1.0) / x["n"]))
        alike = F.when(a["n"] > 0, z <= MAX_Z).otherwise(False)
        run = F.when(alike, a["run"]).otherwise(x["range"])
        placed = F.struct(x["range"].alias("range"), run.alias("run"))
        pooled = [F.when(alike, whole).otherwise(own) for whole, own in ((n, x["n"]), (b, x["b"]))]
        return F.struct(pooled[0].alias("n"), pooled[1].alias("b"), run.alias("run"), F.concat(a["out"], F.array(placed)).alias("out")).cast(kind)

    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(-1).alias("run"), F.array().alias("out")).cast(kind)
    return F.aggregate(F.array_sort(ranges), none, step, lambda a: a["out"])


_COUNTS = ("pages", "labelled", "bad", "shapes")


def _level(shapes: DataFrame, depth: int) -> DataFrame:
    """shapes (host, shape, node, prior, pages, labelled, bad) one level down: node is the template so far."""
    sums = lambda *more: [*[F.sum(c).alias(c) for c in _COUNTS], F.max("prior").alias("prior"), *more]
    step = shapes.drop("ended").withColumn("segment", F.coalesce(F.get("shape", F.lit(depth)), F.lit("{end}"))).withColumn("shapes", F.lit(1))
    children = step.groupBy("host", "node", "segment").agg(*sums())
    special = F.col("segment").startswith("{") & ~F.col("segment").startswith("{{")
    known = ~special & (F.col("labelled") >= MIN_LABELLED)
    at = F.least(F.floor(F.col("bad") * RANGES / F.col("labelled")), F.lit(RANGES - 1)).cast("int")
    kind = F.when(special, F.col("segment")).when(~known, "{*}").otherwise("{~}")
    kinds = children.withColumn("range", F.when(known, at).otherwise(-1)).withColumn("kind", kind)
    groups = kinds.groupBy("host", "node", "kind", "range").agg(*sums(F.count("*").alias("children"), F.min("segment").alias("one")))
    point = F.struct("range", F.col("labelled").alias("n"), F.col("bad").alias("b"))
    arrays = groups.where("range >= 0").groupBy("host", "node").agg(F.collect_list(point).alias("r"))
    runs = arrays.select("host", "node", F.explode(merged_ranges(F.col("r"))).alias("x")).select("host", "node", "x.range", "x.run")
    placed = groups.join(runs, ["host", "node", "range"], "left").withColumn("run", F.coalesce("run", F.lit(-1)))
    branches = placed.groupBy("host", "node", "kind", "run").agg(*sums(F.sum("children").alias("children"), F.min("one").alias("one")))
    alone = (F.col("children") == 1) & F.col("kind").isin("{*}", "{~}")
    name = F.when(alone, F.col("one")).when(F.col("run") < 0, F.col("kind")).otherwise(F.concat(F.lit("{~"), F.col("run"), F.lit("}")))
    smoothed = (F.col("bad") + PRIOR * F.col("prior")) / (F.col("labelled") + PRIOR)
    to = branches.select("host", "node", "kind", "run", name.alias("name"), smoothed.alias("share"), F.col("shapes").alias("left"))
    # from segment to range, from range to run; the table between has some RANGES rows a node
    named = placed.select("host", "node", "kind", "range", "run").join(to, ["host", "node", "kind", "run"]).drop("run")
    mapped = kinds.select("host", "node", "segment", "kind", "range").join(named, ["host", "node", "kind", "range"]).drop("kind", "range")
    down = step.join(mapped, ["host", "node", "segment"])
    end = F.col("segment") == "{end}"
    rest = F.array_join(F.slice("shape", depth + 2, F.greatest(F.size("shape") - depth - 1, F.lit(0))), "/")
    below = F.concat("node", F.lit("/"), "name")
    node = F.when(end, F.col("node")).when((F.col("left") == 1) & (rest != ""), F.concat(below, F.lit("/"), rest)).otherwise(below)
    return down.select("host", "shape", node.alias("node"), F.col("share").alias("prior"), "pages", "labelled", "bad", (end | (F.col("left") == 1)).alias("ended"))


def template_tree(pages: DataFrame) -> DataFrame:
    """(host, shape, pages, template, purity) of pages (host, shape, bad); bad is null where a page has no label.

    purity is the template's smoothed share of good pages, null where the host has no labelled page.
    """
    known = F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))
    shapes = stored(pages.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), known.alias("bad")), "url-shapes")
    total, bad = shapes.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (bad + 1) / (total + 2)
    hosts = shapes.groupBy("host").agg(((F.sum("bad") + PRIOR * overall) / (F.sum("labelled") + PRIOR)).alias("prior"), F.sum("labelled").alias("known"))
    level, done, depth = shapes.join(hosts.select("host", "prior"), "host").withColumn("node", F.lit("")), [], 0
    while True:
        level = stored(_level(level, depth), "url-level")
        done.append(level.where("ended"))
        level, depth = level.where(~F.col("ended")), depth + 1
        if level.isEmpty():
            break
    marked = hosts.select(F.col("host").alias("of"), "known")
    purity = F.when(F.col("known") > 0, 1 - F.col("prior"))
    named = reduce(DataFrame.union, done).join(marked, F.col("host") == F.col("of"))
    return named.select("host", "shape", "pages", F.when(F.col("node") == "", "/").otherwise(F.col("node")).alias("template"), purity.alias("purity"))


def _shape_key(host: str, shape: str) -> Column:
    """One string for a host and shape; neither hosts nor segments hold a slash."""
    return F.md5(F.concat(F.col(host), F.lit("/"), F.array_join(shape, "/")))


def judged(pages: DataFrame, labels: DataFrame, rules: dict[str, str], url: str = "url") -> DataFrame:
    """pages with host, path, rule, template, purity and verdict; labels is (page_id, bad boolean).

    Every row of pages comes back once: repeated rows too. A null or malformed url has empty host and path and is
    judged by the template of that empty path. A page with several labels is bad if one of them is. A rule's verdict
    goes before the template's. Columns of pages with these names, in any case, are replaced, others stay; labels of no
    page and null labels are ignored. Whole urls are used, however long. An empty table gives an empty table.
    """
    ours = ("host", "path", "rule", "template", "purity", "verdict")
    kept = pages.select(*columns_but(pages, *ours))
    host, path = url_parts(F.col(url))
    own = kept.withColumn("host", host).withColumn("path", path)
    shape, key, named = (fresh(own, x) for x in ("shape", "shape_key", "tree"))
    own = own.withColumn(shape, segments(F.col("path")))
    marks = labels.where("bad is not null").groupBy(F.col("page_id").alias("l_id")).agg(F.max("bad").alias("l_bad"))
    seen = own.select("page_id", "host", F.col(shape).alias("shape")).join(marks, F.col("page_id") == F.col("l_id"), "left")
    tree = template_tree(seen.select("host", "shape", F.col("l_bad").alias("bad")))
    of = tree.select(_shape_key("host", "shape").alias("key"), "pages", "template", "purity")
    keyed = own.withColumn(key, _shape_key("host", shape))
    out = joined_copies(keyed, of.withColumnRenamed("key", key), key, "pages", F.xxhash64("page_id"), named)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col(named)["purity"] < 1 - THRESHOLD, "block").otherwise("allow")
    made = [rule.alias("rule"), F.col(named)["template"].alias("template"), F.col(named)["purity"].alias("purity"), F.coalesce(verdict, method).alias("verdict")]
    return out.select(*columns_but(kept), "host", "path", *made)


#: The rules of op1.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


#: Levels that the SQL spells out; the given tables' paths are shorter.
SQL_LEVELS = 6


def _level_sql(d: int) -> str:
    """The tables of one level, from v{d} to v{d + 1}."""
    special = "(starts_with(segment, '{') and not starts_with(segment, '{{'))"
    sums = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in _COUNTS) + ", max(prior) as prior"
    p = "((x.b + y.b) / (x.n + y.n))"
    z = f"abs(x.b / x.n - y.b / y.n) / sqrt(greatest({p} * (1 - {p}), cast(1e-9 as double)) * (1 / x.n + 1 / y.n))"
    return f"""
st{d} as (select *, coalesce(shape[{d + 1}], '{{end}}') as segment, 1 as shapes from v{d} where not ended),
ch{d} as (select host, node, segment, {sums} from st{d} group by all),
ki{d} as (select *, case when not {special} and labelled >= {MIN_LABELLED} then cast(least(floor(bad * {RANGES} / labelled), {RANGES - 1}) as integer) end as range,
  case when {special} then segment when labelled < {MIN_LABELLED} then '{{*}}' else '{{~}}' end as kind from ch{d}),
gr{d} as (select host, node, kind, range, {sums}, count(*) as children, min(segment) as one from ki{d} group by host, node, kind, range),
ar{d} as (select host, node, list_reduce(list({{'n': labelled, 'b': bad, 'run': range, 'places': [{{'range': range, 'run': range}}]}} order by range),
    lambda x, y: case when {z} <= {MAX_Z} then {{'n': x.n + y.n, 'b': x.b + y.b, 'run': x.run, 'places': list_append(x.places, {{'range': y.run, 'run': x.run}})}}
      else {{'n': y.n, 'b': y.b, 'run': y.run, 'places': list_concat(x.places, y.places)}} end) as r from gr{d} where range is not null group by host, node),
ru{d} as (select host, node, x.range, x.run from (select host, node, unnest(r.places) as x from ar{d})),
pl{d} as (select gr{d}.*, run from gr{d} left join ru{d} using (host, node, range)),
br{d} as (select host, node, kind, run, (cast(sum(bad) as double) + {PRIOR} * max(prior)) / (cast(sum(labelled) as double) + {PRIOR}) as share, sum(shapes) as remain,
  case when sum(children) = 1 and kind in ('{{*}}', '{{~}}') then min(one) when run is null then kind else '{{~' || run || '}}' end as name from pl{d} group by host, node, kind, run),
v{d + 1} as materialized (select s.host, s.shape, case when s.segment = '{{end}}' then s.node when remain = 1 and len(s.shape) > {d + 1} then s.node || '/' || name || '/' || array_to_string(s.shape[{d + 2}:], '/') else s.node || '/' || name end as node,
    share as prior, s.pages, s.labelled, s.bad, s.segment = '{{end}}' or remain = 1 as ended
  from st{d} s join ki{d} k on s.host = k.host and s.node = k.node and s.segment = k.segment
  join pl{d} p on k.host = p.host and k.node = p.node and k.kind = p.kind and k.range is not distinct from p.range
  join br{d} b on p.host = b.host and p.node = b.node and p.kind = b.kind and p.run is not distinct from b.run)"""


def _sql() -> str:
    """DuckDB SQL for op1: judged() over pages with the labels of documents."""
    rule, verdict = "null", f"case when purity < {1 - THRESHOLD} then 'block' else 'allow' end"
    for text in sorted(RULES, key=len):
        own, _, rest = text.partition("/")
        fits = f"(host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '/{rest}')"
        rule, verdict = f"case when {fits} then '{text}' else {rule} end", f"case when {fits} then '{RULES[text]}' else {verdict} end"
    ending = r"\.[A-Za-z0-9]{1,5}$"
    named = rf"""case when regexp_matches(regexp_replace(x, '{ending}', ''), '^\d{{4}}-\d{{2}}(-\d{{2}})?$') then '{{date}}' || regexp_extract(x, '{ending}') when regexp_matches(regexp_replace(x, '{ending}', ''), '^\d+$') then '{{number}}' || regexp_extract(x, '{ending}')
      when regexp_matches(regexp_replace(x, '{ending}', ''), '^[0-9a-fA-F-]{{8,}}$') and regexp_matches(regexp_replace(x, '{ending}', ''), '\d') then '{{hex}}' || regexp_extract(x, '{ending}') when length(regexp_replace(x, '{ending}', '')) > 40 then '{{long}}' || regexp_extract(x, '{ending}') else replace(x, '{{', '{{{{') end"""
    done = " union all ".join(f"select host, shape, node, prior from v{d} where ended" for d in range(1, SQL_LEVELS + 1))
    return f"""
with u as (select page_id, coalesce(case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end, '') as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, translate(raw, '{LETTERS}', '{LETTERS.lower()}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
w as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from p),
own as materialized (select page_id, host, path, list_transform(parts, lambda x: {named}) as shape from w),
marks as (select doc_id, max(cast(quality = 0 or toxic = 1 as integer)) as bad from labels where (quality = 0 or toxic = 1) is not null group by doc_id),
shapes as materialized (select host, shape, count(*) as pages, count(bad) as labelled, cast(coalesce(sum(bad), 0) as bigint) as bad from own left join marks on page_id = doc_id group by host, shape),
overall as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(labelled), 0) + 2) as o from shapes),
hosts as (select host, (cast(sum(bad) as double) + {PRIOR} * max(o)) / (cast(sum(labelled) as double) + {PRIOR}) as prior, sum(labelled) as known from shapes, overall group by host),
v0 as (select shapes.host, shape, '' as node, cast(prior as double) as prior, pages, labelled, bad, false as ended from shapes join hosts on shapes.host = hosts.host),
{",".join(map(_level_sql, range(SQL_LEVELS)))},
tree as (select d.host, shape, case when node = '' then '/' else node end as template, case when known > 0 then 1 - d.prior end as purity from ({done}) d join hosts on d.host = hosts.host)
select page_id, own.host, path, {rule.replace('host', 'own.host')} as rule, template, purity, {verdict.replace('host', 'own.host')} as verdict
from own join tree on own.host = tree.host and own.shape = tree.shape
"""


SQL = _sql()
