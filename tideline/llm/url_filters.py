"""URL filter by host rules and a path-template tree; DataFrame functions only.

Where no rule decides, the method does. Per host the path segments form a tree. Level by
level, rare children of a node with many become wildcards, so that paths fall into
templates. A node of at most FANOUT distinct paths has no rare children further down, so
only larger ones are looked at again, to any depth. Templates that differ in one segment
are branches of one node; a template whose share of blocked labels is statistically like
that of such a set of branches takes their pooled counts, from the set with most labels.

The labels are URLs that the rules decide, or any others given as `labelled`. Most
templates have few or none of their own, so purity is smoothed from the general to the
particular: the rate of all labels is the prior of a template's form (digits aside) over
all hosts, that of the form within a site (the last two parts of the host), and that of
the template itself; each prior counts as PRIOR labels. Templates whose purity reaches
REJECT are rejected.

Hot hosts, nodes, templates and URLs: a key with over a thousandth of all rows is joined
by broadcast, and there are fewer than 1,000 of those; the others are joined by shuffle.

Defined cases: null URLs and URLs without "://" have an empty host and path, no rule and
the template of the empty path; repeated rows are each judged; an empty table gives no
rows; further columns of the input are not read, and the key may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import dealt_join, stage, table

#: Verdict, host, start of the path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Children that a node may have before the rare ones become wildcards.
FANOUT = 12
#: Share of its node's pages that keeps a child literal in a node with many children.
KEEP_PERCENT = 5
#: A branch is like its siblings if its share differs by at most so many standard errors.
SIMILAR_Z = 2.0
#: Labels that a prior counts as, and the purity that rejects.
PRIOR, REJECT = 4.0, 0.8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (like `net/`) and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def form(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]+", "{n}")


def templates(paths: DataFrame) -> DataFrame:
    """paths: host, path, n, labelled, blocked; distinct by host and path. Adds the template of each path.

    Each level is a scratch table, else it would compute all levels above it again.
    """
    segs = F.split(F.regexp_replace("path", "^/", ""), "/")
    open_ = stage(paths.withColumn("segs", segs).withColumn("prefix", F.lit("")), "paths")
    keep = ["host", "path", "n", "labelled", "blocked"]
    done = open_.limit(0).select(*keep, F.lit("").alias("template"))
    d = 0
    while True:
        # a split path has one segment at least
        open_ = open_.withColumn("seg", F.get("segs", F.lit(d)))
        kids = stage(open_.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("kid_n"), F.count("*").alias("m")), f"kids{d}")
        n_kids, total = kids.agg(F.count("*"), F.sum("m")).first()
        if not n_kids:
            return stage(done, "templates")
        nodes = stage(kids.groupBy("host", "prefix").agg(F.sum("kid_n").alias("node_n"), F.count("*").alias("n_kids")), f"nodes{d}")
        nodes = nodes.withColumn("w", F.col("n_kids"))
        rare = (F.col("n_kids") > FANOUT) & (F.col("kid_n") * 100 < F.col("node_n") * KEEP_PERCENT)
        # a rare child keeps what its digits leave over if it has digits, else nothing
        label = F.when(~rare, F.col("seg")).when(form(F.col("seg")) != F.col("seg"), form(F.col("seg"))).otherwise("*")
        named = dealt_join(kids, nodes, ["host", "prefix"], "w", n_kids).select("host", "prefix", "seg", "m", label.alias("label"))
        # what several children share a label for is one child
        below = named.groupBy("host", "prefix", "label").agg(F.sum("m").alias("below"), F.count("*").alias("w"))
        named = dealt_join(stage(named, f"labels{d}"), stage(below, f"below{d}"), ["host", "prefix", "label"], "w", n_kids)
        named = stage(named.select("host", "prefix", "seg", "m", "label", (F.col("below") > FANOUT).alias("large")), f"named{d}")
        open_ = dealt_join(open_, named, ["host", "prefix", "seg"], "m", total)
        open_ = stage(open_.withColumn("prefix", F.concat("prefix", F.lit("/"), "label")).drop("seg", "label"), f"level{d}")
        d += 1
        # what lies below a node of few paths stays as it is
        left = F.slice("segs", d + 1, F.size("segs"))
        whole = F.when(F.size("segs") > d, F.concat("prefix", F.lit("/"), F.array_join(left, "/"))).otherwise(F.col("prefix"))
        closed = ~F.col("large") | (F.size("segs") <= d)
        done = done.unionByName(open_.filter(closed).select(*keep, whole.alias("template")))
        open_ = open_.filter(~closed).drop("large")


def purities(per: DataFrame) -> DataFrame:
    """per: host, template, n, l (labels), b (blocked ones). Adds purity.

    A set of branches is a template without one of its segments; it is named by the
    exclusive or of the hashes of the others with their places.
    """
    name = lambda seg, i: F.xxhash64(i, seg)
    segs = F.split(F.substring("template", 2, 1 << 30), "/")
    per = per.withColumn("segs", segs)
    whole = F.aggregate(F.transform("segs", name), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    some = per.filter("l > 0").withColumn("whole", whole).select("host", "template", "l", "b", "whole", F.posexplode("segs").alias("i", "seg"))
    some = stage(some.select("host", "template", "l", "b", "i", F.col("whole").bitwiseXOR(name(F.col("seg"), F.col("i"))).alias("others")), "branches")
    pool = stage(some.groupBy("host", "i", "others").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count("*").alias("m")), "pools")
    met = dealt_join(some, pool, ["host", "i", "others"], "m", some.count())
    # cross-multiplied: |b/l - pb/pl| <= z sqrt(p (1 - p) / l), p = pb/pl, without division
    gap = (F.col("b") * F.col("pl") - F.col("pb") * F.col("l")).cast("double")
    like = gap * gap <= SIMILAR_Z**2 * F.col("pb") * (F.col("pl") - F.col("pb")) * F.col("l")
    best = met.filter(like).groupBy("host", "template").agg(F.max(F.struct("pl", (-F.col("i")).alias("i"), "pb")).alias("x"))
    best = best.select("host", "template", F.col("x.pl").alias("pl"), F.col("x.pb").alias("pb"))
    zero = lambda a, b: F.coalesce(a, b).cast("double")
    rows = per.drop("segs").join(best, ["host", "template"], "left").withColumn("form", form(F.col("template"))).withColumn("site", F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0))
    rows = stage(rows, "merged")
    site = stage(rows.groupBy("site", "form").agg(F.sum("l").alias("sl"), F.sum("b").alias("sb"), F.count("*").alias("m")), "sites")
    shape = stage(site.groupBy("form").agg(F.sum("sl").alias("fl"), F.sum("sb").alias("fb"), F.count("*").alias("w")), "forms")
    # one row by construction
    all_ = shape.agg(F.coalesce(F.sum("fl"), F.lit(0)).alias("al"), F.coalesce(F.sum("fb"), F.lit(0)).alias("ab"))
    rate = (F.col("ab") + 1.0) / (F.col("al") + 2.0)
    shape = stage(shape.crossJoin(F.broadcast(all_)).select("form", "w", ((F.col("fb") + PRIOR * rate) / (F.col("fl") + PRIOR)).alias("rate")), "form_rates")
    site = dealt_join(site, shape, ["form"], "w", site.count())
    site = stage(site.select("site", "form", "m", ((F.col("sb") + PRIOR * F.col("rate")) / (F.col("sl") + PRIOR)).alias("rate")), "site_rates")
    rows = dealt_join(rows, site, ["site", "form"], "m", rows.count())
    b, n = zero(F.col("pb"), F.col("b")), zero(F.col("pl"), F.col("l"))
    return rows.select("host", "template", "n", ((b + PRIOR * F.col("rate")) / (n + PRIOR)).alias("purity"))


def rejected(paths: DataFrame) -> DataFrame:
    """(host, path, n, template, reject) of every distinct path."""
    known = templates(paths)
    per = stage(known.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("n")), "per")
    verdict = stage(purities(per).select("host", "template", F.col("n").alias("m"), (F.col("purity") >= REJECT).alias("reject")), "verdicts")
    return stage(dealt_join(known, verdict, ["host", "template"], "m", known.count()).select("host", "path", "n", "template", "reject"), "rejected")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Judge every row of pages. labelled: url, blocked (boolean); default: the URLs that the rules decide.

    Returns key, host, path, rule, verdict, template.
    """
    host, path = split_url(F.col(f"`{url}`"))
    base = pages.select(F.col(f"`{key}`").alias("_tl_key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = stage(base.withColumn("rule", rule).withColumn("by_rule", verdict), "pages")
    known = F.lit(0) if labelled is not None else F.col("by_rule").isNotNull().cast("int")
    bad = F.lit(0) if labelled is not None else F.coalesce((F.col("by_rule") == "block").cast("int"), F.lit(0))
    seen = base.select("host", "path", F.lit(1).alias("n"), known.alias("labelled"), bad.alias("blocked"))
    if labelled is not None:
        host, path = split_url(F.col("url"))
        more = labelled.filter("blocked IS NOT NULL").select(host.alias("host"), path.alias("path"), F.lit(1).alias("n"), F.lit(1).alias("labelled"), F.col("blocked").cast("int").alias("blocked"))
        seen = seen.unionByName(more)
    seen = seen.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
    out = dealt_join(base, rejected(seen), ["host", "path"], "n", base.count())
    verdict = F.coalesce("by_rule", F.when(F.col("reject"), "block").otherwise("allow"))
    return out.select(F.col("_tl_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template")


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _rule_sql(what: str) -> str:
    cases = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {cases} ELSE NULL END"


_FORM_SQL = "regexp_replace({}, '[0-9]+', '{{n}}', 'g')"
OP10_SQL = f"""WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
base AS (SELECT *, {_rule_sql('rule')} AS rule, {_rule_sql('verdict')} AS by_rule FROM h),
seen AS (SELECT host, path, count(*) AS n, count(by_rule) AS labelled, count(*) FILTER (by_rule = 'block') AS blocked FROM base GROUP BY ALL),
p AS (SELECT 0 AS d, host, path, n, labelled, blocked, string_split(regexp_replace(path, '^/', ''), '/') AS segs, '' AS prefix FROM seen
  UNION ALL SELECT d + 1, host, path, n, labelled, blocked, segs, prefix || '/' || CASE
    WHEN NOT (n_kids > {FANOUT} AND kid_n * 100 < node_n * {KEEP_PERCENT}) THEN seg
    WHEN {_FORM_SQL.format("seg")} <> seg THEN {_FORM_SQL.format("seg")} ELSE '*' END
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, prefix, seg) AS kid_n, sum(n) OVER (PARTITION BY host, prefix) AS node_n,
      count(DISTINCT seg) OVER (PARTITION BY host, prefix) AS n_kids
    FROM (SELECT *, segs[d + 1] AS seg FROM p WHERE len(segs) > d))),
known AS (SELECT host, path, labelled, blocked, prefix AS template FROM p WHERE d = len(segs)),
per AS (SELECT host, template, string_split(substr(template, 2), '/') AS segs, sum(labelled) AS l, sum(blocked) AS b FROM known GROUP BY ALL),
branches AS (SELECT host, template, l, b, i, list_concat(segs[:i - 1], ['/'], segs[i + 1:]) AS others
  FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS i FROM per WHERE l > 0)),
pools AS (SELECT host, i, others, sum(l) AS pl, sum(b) AS pb FROM branches GROUP BY ALL),
alike AS (SELECT host, template, pl, pb, row_number() OVER (PARTITION BY host, template ORDER BY pl DESC, i) AS k
  FROM branches JOIN pools USING (host, i, others) WHERE CAST(b * pl - pb * l AS DOUBLE) ** 2 <= {SIMILAR_Z**2} * pb * (pl - pb) * l),
merged AS (SELECT per.host, per.template, l, b, coalesce(pl, l) AS nl, coalesce(pb, b) AS nb, {_FORM_SQL.format("per.template")} AS form,
  regexp_extract(per.host, '[^.]*\\.?[^.]*$', 0) AS site FROM per LEFT JOIN alike ON per.host = alike.host AND per.template = alike.template AND k = 1),
sites AS (SELECT site, form, sum(l) AS sl, sum(b) AS sb FROM merged GROUP BY ALL),
whole AS (SELECT (sum(sb) + 1.0::DOUBLE) / (sum(sl) + 2.0::DOUBLE) AS rate FROM sites),
forms AS (SELECT form, (sum(sb) + {PRIOR}::DOUBLE * any_value(rate)) / (sum(sl) + {PRIOR}::DOUBLE) AS rate FROM sites, whole GROUP BY form),
verdicts AS (SELECT host, template, (nb + {PRIOR}::DOUBLE * ((sb + {PRIOR}::DOUBLE * rate) / (sl + {PRIOR}::DOUBLE))) / (nl + {PRIOR}::DOUBLE) >= {REJECT} AS reject
  FROM merged JOIN sites USING (site, form) JOIN forms USING (form))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN reject THEN 'block' ELSE 'allow' END) AS verdict, template
FROM base JOIN known USING (host, path) JOIN verdicts USING (host, template)"""
