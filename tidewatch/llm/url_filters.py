"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for the rest.

The main path is DataFrame expressions only.  Every page's host, path, longest fitting rule and lexical features come
from built-in functions; the trees are trained on the driver from a bounded sample of the URLs that a rule decides, and
return to the plan as nested ``CASE`` expressions.  The query is one projection of the scan: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, gbt


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: Host, path, allowed.
RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)
#: Types of columns that tell rows apart.
_HASHED = ("string", "byte", "short", "integer", "long", "date", "timestamp")
#: Labelled URLs that the trees are fitted on, at most; the smallest hashes are taken.
TRAIN_ROWS = 6000
#: Host endings with a learned statistic, at most.
SUFFIXES = 200


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #``, then up to ``? #``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and decision of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's path.  Of several, the one with the most
    characters wins, and of equally long ones the one that stands first.
    """
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, allow = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.allow)).otherwise(allow)
    return name, allow


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "suffix_length", "hyphens", "fragment", "suffix_rate")


def lexical_features(df: DataFrame) -> DataFrame:
    """Adds the features as columns ``_f_*`` beside ``_url``, ``_host`` and ``_path``."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    n = F.length(url)
    chars = F.split(url, "")
    entropy = F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda acc, c: acc
        - F.when(c == "", 0.0).otherwise(
            ((n - F.length(F.replace(url, c, F.lit("")))) / n) * F.log2((n - F.length(F.replace(url, c, F.lit("")))) / n)
        ),
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    columns = {
        "length": n,
        "host_length": F.length("_host"),
        "path_length": F.length("_path"),
        "depth": F.size(F.filter(F.split("_path", "/"), lambda s: s != "")),
        "labels": F.when(F.col("_host") == "", 0).otherwise(F.size(F.split("_host", r"\."))),
        "digit_ratio": F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, F.round(entropy, 9)).otherwise(0.0),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "suffix_length": F.length("_suffix"),
        "hyphens": F.length(F.regexp_replace(url, "[^-_]", "")),
        "fragment": F.when(url.contains("#"), 1).otherwise(0),
    }
    return df.withColumns({f"_f_{k}": v.cast("double") for k, v in columns.items()})


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` in place of any columns of these names.

    A null URL and one without ``://`` have an empty host and path; no rule fits them and the trees decide.  Without a
    labelled URL every page that no rule fits is allowed.  Whole URLs are read, however long.  Repeated rows get equal values;
    an empty table gives an empty one.  The trees are fitted on at most ``train_rows`` URLs, those of the smallest hash.
    """
    own = ("host", "path", "rule", "verdict", "score")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in own]
    base = pages.select(*kept, F.col(url_col).cast("string").alias("_url"))
    host, path = url_parts(F.col("_url"))
    base = base.withColumns({"_host": host, "_path": path})
    name, allow = best_rule(F.col("_host"), F.col("_path"), rules)
    base = base.withColumns({"_rule": name, "_allow": allow, "_suffix": F.substring_index("_host", ".", -1)})
    base = lexical_features(base)

    plain = [f"_f_{k}" for k in FEATURES[:-1]]
    # by all of a row that can be hashed, so that a URL in many rows is thinned like others
    row = F.xxhash64("_url", *[F.col(f"`{f.name}`") for f in pages.schema.fields if f.name.lower() not in own and f.dataType.typeName() in _HASHED])
    ruled = base.withColumn("_h", row).filter(F.col("_allow").isNotNull()).select("_suffix", "_allow", *plain, "_h")
    sample = (
        common.thinned(ruled, F.col("_h"), train_rows)
        .orderBy("_h", *plain)
        .limit(train_rows)
        .collect()
    )
    y = np.array([float(r["_allow"]) for r in sample])
    prior = float(y.mean()) if len(y) else 1.0
    seen: dict[str, list[float]] = {}
    for r in sample:
        seen.setdefault(r["_suffix"], []).append(float(r["_allow"]))
    most = sorted(seen, key=lambda s: (-len(seen[s]), s))[:SUFFIXES]
    rate = {s: (sum(seen[s]) + 10 * prior) / (len(seen[s]) + 10) for s in most}
    x = np.array([[*(r[c] for c in plain), rate.get(r["_suffix"], prior)] for r in sample]).reshape(len(sample), len(FEATURES))
    model = gbt.fit(x, y, trees=20, depth=3, rate=0.3) if len(y) else gbt.constant(1.0)

    table = F.create_map(*[F.lit(v) for kv in rate.items() for v in kv]) if rate else None
    suffix_rate = F.coalesce(table[F.col("_suffix")], F.lit(prior)) if rate else F.lit(prior)
    base = base.withColumn("_f_suffix_rate", suffix_rate)
    score = model.to_column([F.col(f"_f_{k}") for k in FEATURES])
    verdict = F.when(F.coalesce(F.col("_allow"), F.col("score") >= 0.5), "allow").otherwise("block")
    return base.withColumn("score", score).select(
        *kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"), "score"
    )
