"""Secret scanning with multipart credential linking (DataFrame operations only).

Strong spans (assignments of secrets, access key ids, long hex) are reported by themselves. Weak
candidates (other identifiers, opaque strings, endpoints) mean little alone: they are reported
only where parts of the complementary roles lie within one scope, that is at most ``scope`` code
points apart: one strong part of another role, or weak parts of both other roles.

The interval join needs only each candidate's nearest part of every role and strength on either
side, so it is a window over a text's spans in order, not a product of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .spans import count_kind, find_all, joined

_KEY = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]+"
BASE = ("assign", "access", "hex")
WEAK = ("ident", "opaque", "weak_assign", "endpoint")
#: Role of each kind: access identifier, secret, or endpoint.
ROLES = {"access": "id", "ident": "id", "assign": "secret", "hex": "secret", "opaque": "secret", "weak_assign": "secret", "endpoint": "endpoint"}
SCOPE = 200
_AFTER = r"""["']?\x20*[:=]\x20*["']?"""
_WEAK_PATTERNS = {
    "ident": rf"(?i)(?<![a-z0-9])(?:access_?key_?id|client_?id|account_?id|user(?:name)?|login){_AFTER}[A-Za-z0-9@._-]{{4,}}",
    "opaque": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/=_-])",
    "weak_assign": rf"(?i)(?<![a-z0-9])(?:pwd|pass(?:phrase)?|auth|credentials?|private_?key|secret_?access_?key|secret_?key|access_?key){_AFTER}[A-Za-z0-9+/_.=-]{{6,}}",
    "endpoint": r"(?i)(?<![a-z0-9])(?:https?|ftp|sftp|ssh|amqps?|mongodb|mysql|redis|postgres(?:ql)?)://[^\x20\x09-\x0D\"'<>]{4,}",
}


def base_spans(text: Column) -> Column:
    """The strong spans of a text."""
    assigned = F.filter(find_all(text, _KEY + _VALUE, "assign"), lambda s: F.length(F.regexp_replace(s["match"], "^" + _KEY, "")) >= 8)
    access = find_all(text, r"AKIA[A-Z0-9]{12,}+", "access")
    hexes = find_all(text, r"[0-9a-f]{32,}+", "hex")
    return F.concat(assigned, access, hexes)


def weak_spans(text: Column) -> Column:
    """The weak candidates of a text, linked or not."""
    return F.concat(*[find_all(text, p, k) for k, p in _WEAK_PATTERNS.items()])


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Of rows (row, kind, start, end, match, strong), the weak ones whose complementary parts are
    within the scope and that overlap no strong span. An opaque string that is the value of a named
    candidate is that candidate, not one more.

    What is ahead of a span is taken in reverse order, so every frame grows by a row at a time.
    """
    key = Window.partitionBy("row")
    before = key.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = key.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("kind"))
    # a named candidate has its name before the value, so it begins before the opaque string
    named = F.max(F.when(F.col("kind").isin("ident", "weak_assign"), F.col("end"))).over(before)
    rows = parts.withColumn("role", role).withColumn("named", named)
    rows = rows.where((F.col("kind") != "opaque") | F.coalesce(F.col("named") < F.col("end"), F.lit(True)))
    near = {}
    for strong in (True, False):
        for r in ("id", "secret", "endpoint"):
            mine = (F.col("role") == r) & (F.col("strong") == strong)
            left, right = F.max(F.when(mine, F.col("end"))).over(before), F.min(F.when(mine, F.col("start"))).over(after)
            rows = rows.withColumns({f"l_{r}_{strong}": left, f"r_{r}_{strong}": right})
            near[r, strong] = F.coalesce(F.col("start") - F.col(f"l_{r}_{strong}") <= scope, F.lit(False)) | F.coalesce(F.col(f"r_{r}_{strong}") - F.col("end") <= scope, F.lit(False))
    others = {"id": ("secret", "endpoint"), "secret": ("id", "endpoint"), "endpoint": ("id", "secret")}
    wanted = F.lit(False)
    for r, (x, y) in others.items():
        ok = near[x, True] | near[y, True] | (near[x, False] & near[y, False])
        wanted = wanted | ((F.col("role") == r) & ok)
    clear = F.lit(True)
    for r in ("id", "secret", "endpoint"):
        clear = clear & F.coalesce(F.col(f"l_{r}_True") <= F.col("start"), F.lit(True)) & F.coalesce(F.col(f"r_{r}_True") >= F.col("end"), F.lit(True))
    return rows.where(~F.col("strong") & wanted & clear).select("row", "kind", "start", "end", "match")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, base, added), a row for each row of ``docs``: arrays of (kind, start, end, match), positions
    in code points, end exclusive.

    A null text counts as empty; repeated rows each have their spans; ties in position go by kind.
    An empty table gives none. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("id"), base_spans(text).alias("base"), weak_spans(text).alias("weak"))
    # Written once: the texts are searched once, and each row has a number that stays.
    found = cut(found.withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    unsure = found.where(F.size("weak") > 0)
    flat = lambda c, strong: unsure.select("row", F.inline(c)).withColumn("strong", F.lit(strong))
    added = linked(flat("base", True).union(flat("weak", False)), scope)
    added = added.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "match"))).alias("added"))
    none = F.expr("filter(base, s -> false)")
    return found.join(added, "row", "left").select("id", "base", F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of base spans and the list of all spans."""
    kinds = BASE + WEAK
    return found.select(
        F.col("id").alias("doc_id"),
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base"), kinds, False).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), kinds, False).alias("spans"),
    )
