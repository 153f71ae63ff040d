"""URL filtering by prefix rules and link-graph propagation, with DataFrame functions only.

Rules decide the urls they fit.  The rest follow their host: trust flows along
host links from hosts with allowed pages, distrust flows against the links from
hosts with blocked pages (who links to a blocked host becomes suspect), both as
personalised PageRank.  A host is blocked when its distrust exceeds its trust.

A walk starts with MASS, dealt evenly to the seeds of its kind.  What stands at
a host after a step counts to its rank, and DAMPING percent of it goes on along
its links, in proportion to their number.  The walk ends when nothing moves any
more, or after STEPS steps, when at most DAMPING ** STEPS (0.01 %) of the mass can
still be on its way.  A host without links passes nothing on; to return its mass to the
seeds would multiply all ranks of a kind by one factor, and links would change
the ranks of hosts that they do not lead to.

Masses are integers and every product is divided once, rounding down, so sums do not
depend on the order of rows and every run and every engine gives the same
verdicts.  Less than 1e-18 of the mass counts as none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.shared import ascii_lower, discard, materialise, read_table, text_or_empty

#: Mass of each kind of seeds, damping in percent, steps of a walk at most.
MASS = 10**18
DAMPING = 85
STEPS = 57

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: str | Column) -> Column:
    return ascii_lower(F.regexp_extract(text_or_empty(url), _URL, 1))


def path_of(url: str | Column) -> Column:
    return F.regexp_extract(text_or_empty(url), _URL, 2)


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null.  Rules are a literal list, so no join is needed."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, value(rule)) if out is None else out.when(fits, value(rule))
    return F.lit(None).cast("string") if out is None else out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: absolute links between two different hosts."""
    links = pages.select(host_of(url_col).alias("src"), F.explode(F.regexp_extract_all(text_or_empty(html_col), F.lit(_LINK), 1)).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst"))
    return links.where((F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def flows(edges: DataFrame) -> DataFrame:
    """kind, u, v, n, out_n: n of u's out_n links lead the walk of a kind from u to v. Trust follows links, distrust goes against them."""
    both = [edges.select(F.lit(kind).alias("kind"), F.col(u).alias("u"), F.col(v).alias("v"), "n") for kind, u, v in (("allow", "src", "dst"), ("block", "dst", "src"))]
    flow = both[0].unionByName(both[1])
    total = materialise(flow.groupBy("kind", "u").agg(F.sum("n").alias("out_n")), "out-links")
    return flow.join(total, ["kind", "u"])


def propagate(seeds: DataFrame, flow: DataFrame, steps: int = STEPS, damping: int = DAMPING) -> DataFrame:
    """kind, host, rank: all mass that stood at a host in the walk of its kind. ``seeds`` has kind, host and mass."""
    state = materialise(seeds.select("kind", "host", F.col("mass").alias("rank"), F.col("mass").alias("moving")), "walk")
    for _ in range(steps):
        here = state.where("moving > 0").select(F.col("kind").alias("k"), "host", F.expr(f"moving div 100 * {damping} + moving % 100 * {damping} div 100").alias("m"))
        moved = flow.join(here, (flow["kind"] == here["k"]) & (flow["u"] == here["host"]))
        # m * n div out_n without an overflow
        part = F.expr("m div out_n * n + m % out_n * n div out_n")
        moved = moved.select("kind", F.col("v").alias("host"), F.lit(0).cast("long").alias("rank"), part.alias("moving"))
        rest = state.select("kind", "host", "rank", F.lit(0).cast("long").alias("moving"))
        both = rest.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("moving").alias("moving"))
        last, state = state, materialise(both.select("kind", "host", (F.col("rank") + F.col("moving")).alias("rank"), "moving"), "walk")
        discard(last)
        if state.where("moving > 0").isEmpty():
            break
    return state.select("kind", "host", "rank")


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, steps: int = STEPS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust.

    A null url or one without ``://`` has an empty host and path, fits no rule
    and is allowed.  A host that no trust or distrust reaches is allowed (equal
    ranks allow).  A null html has no links; without any link between two hosts,
    ranks are the seeds' own mass.  Repeated pages keep a row each and
    count each as links.  Other columns are not read.
    """
    judged = pages.select(F.col(id_col).alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    judged = judged.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules, lambda r: r.name))
    judged = judged.withColumn("ruled", rule_column(F.col("host"), F.col("path"), rules, lambda r: r.verdict))
    flow = materialise(flows(materialise(host_edges(pages, url_col, html_col), "host-edges")), "flows")
    seeds = materialise(judged.where("ruled IS NOT NULL").select(F.col("ruled").alias("kind"), "host").distinct(), "seeds")
    sizes = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    mass = F.lit(0).cast("long")
    for kind, n in sizes.items():
        mass = F.when(F.col("kind") == kind, F.lit(MASS // n).cast("long")).otherwise(mass)
    ranks = propagate(seeds.withColumn("mass", mass), flow, steps)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0).cast("long"))
    ranks = materialise(ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust")), "ranks")
    judged = judged.join(ranks, "host", "left")
    zero = F.lit(0).cast("long")
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    verdict = F.coalesce("ruled", F.when(distrust > trust, "block").otherwise("allow"))
    return judged.select("id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    out = judge_urls(read_table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _op5_sql() -> str:
    """The same method, written out step by step."""
    fits = [
        (r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))")
        for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))
    ]
    case = lambda value: "CASE " + " ".join(f"WHEN {cond} THEN '{value(r)}'" for r, cond in fits) + " END"
    link = r"""(?i)\bhref\s*=\s*["'']?\s*[a-z][a-z0-9+.-]*://([^/?#"''\s>]+)"""
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        f"""
WITH RECURSIVE urls AS (
  SELECT page_id, html, {low(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
judged AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM urls),
links AS (SELECT host AS src, {low("unnest(regexp_extract_all(coalesce(html, ''), '" + link + "', 1))")} AS dst FROM urls),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' GROUP BY 1, 2),
moves AS (SELECT 'allow' AS kind, src AS u, dst AS v, n FROM edges UNION ALL SELECT 'block', dst, src, n FROM edges),
flow AS (SELECT *, sum(n) OVER (PARTITION BY kind, u) AS out_n FROM moves),
seeds AS (SELECT DISTINCT ruled AS kind, host FROM judged WHERE ruled IS NOT NULL),
walk AS (
  SELECT kind, host, CAST({MASS} // count(*) OVER (PARTITION BY kind) AS HUGEINT) AS mass, 0 AS step FROM seeds
  UNION ALL
  SELECT kind, v, CAST(sum((mass * {DAMPING} // 100) * n // out_n) AS HUGEINT) AS moved, step + 1
  FROM (SELECT f.kind, f.v, w.mass, f.n, f.out_n, w.step FROM walk w JOIN flow f ON f.kind = w.kind AND f.u = w.host WHERE w.step < {STEPS})
  GROUP BY kind, v, step HAVING moved > 0),
ranks AS (SELECT kind, host, sum(mass) AS mass FROM walk GROUP BY kind, host)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.ruled, CASE WHEN coalesce(d.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN ranks t ON t.host = j.host AND t.kind = 'allow' LEFT JOIN ranks d ON d.host = j.host AND d.kind = 'block'"""
    )


OP5_SQL = _op5_sql()
