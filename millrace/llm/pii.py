"""Personal data by weak supervision (DataFrame operations on the rows).

Base patterns (email, ip, card, phone) are reported by themselves. Further candidates (local phone
numbers, short cards, IBANs, social security numbers, names after titles, spelled-out addresses,
and base matches that failed their check) come from wider patterns. On every candidate the
labelers vote +1, -1 or 0: a checksum, a gazetteer of context words, words that speak against,
the shape, and the surroundings. Expectation-maximisation estimates each labeler's reliability
without labels. From the resulting probabilities each context word gets its evidence (how much
likelier it is before personal data of a kind than before other candidates); the summed evidence
votes as one more labeler, expectation-maximisation is run again, and a logistic span classifier is
trained on votes, kind, length and evidence.

Rows stay in Spark. The driver fits on tables whose size is bounded by the number of labelers,
kinds, length and evidence classes: the counts of vote patterns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .spans import SPAN, bound, count_kind, find_all, joined, with_surroundings

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "name", "handle", "local_phone", "short_card")
KINDS = BASE + ADDED
# A run of word characters or digits is only tried from its start (or from where the last match
# ended): a later start would reach the same end and fail alike.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)++|[0-9]{2,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_ADDED_PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}[\p{L}'-]++(?:\x20\p{Lu}[\p{L}'-]++)?",
    "handle": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,}+\x20?[(\[]at[)\]]\x20?[a-z0-9-]{2,}+(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[a-z]{2,12})+",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20./-])[0-9]{3,4}(?:[\x20-][0-9]{2,4}){1,3}(?![0-9])",
    "short_card": r"(?<![0-9-])(?:3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|3[068][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{4})(?![0-9])",
}
#: Context words that speak for each kind, and words that speak against all (fixed lists).
GAZETTEER = {
    "email": "mail|email|e-mail|correo|courriel|contact|kontakt|contacto",
    "handle": "mail|email|e-mail|correo|courriel|contact|kontakt|contacto",
    "ip": "ip|host|server|address|adresse|client",
    "card": "card|visa|mastercard|karte|carte|tarjeta|credit|debit",
    "short_card": "card|amex|diners|karte|carte|tarjeta|credit",
    "phone": "phone|tel|telephone|telefon|teléfono|call|mobile|fax|handy",
    "local_phone": "phone|tel|telephone|telefon|teléfono|call|mobile|fax|handy",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "ssn": "ssn|social|security",
    "name": "name|dear|contact|signed|sincerely|liebe|sehr|cher|estimado",
}
AGAINST = "version|isbn|order|invoice|ref|example|test|sample|serial|beispiel|exemple|ejemplo"
LABELERS = ("pattern", "check", "gazetteer", "against", "shape", "edge", "context")
#: Log-odds with which each labeler's vote counts before anything is estimated: checksums say most,
#: shape and surroundings least.
FIRST_ODDS = (2.0, 2.5, 1.5, 1.5, 0.3, 0.3, 1.0)
CONTEXT = 40
#: Context words of the model, the most frequent ones, and the candidates that one must be seen with.
WORDS, LEAST_SEEN = 5000, 5
#: Evidence classes: the summed evidence is cut to this range and rounded.
EVIDENCE = 4
ROUNDS = 60


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """True if the digits' Luhn sum is a multiple of ten."""
    reversed_ = F.transform(_characters(F.reverse(digits)), lambda d: F.ascii(d) - 48)
    doubled = F.transform(reversed_, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _card_ok(s: Column, least: int, most: int) -> Column:
    n = F.length(_digits(s))
    return F.when((n >= least) & (n <= most), luhn(_digits(s))).otherwise(F.lit(False))


def _ip_ok(s: Column) -> Column:
    value = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.length(value(p)) <= 3) & (F.coalesce(value(p).try_cast("int"), F.lit(0)) <= 255))


def _phone_ok(s: Column) -> Column:
    return F.length(_digits(s)).between(8, 15)


def iban_ok(s: Column) -> Column:
    """The mod-97 check of ISO 13616, digit by digit; check digits are 02 to 98."""
    clean = F.regexp_replace(s, r"\x20", "")
    turned = F.concat(F.substring(clean, 5, 40), F.substring(clean, 1, 4))
    rest = F.aggregate(_characters(turned), F.lit(0), lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return (rest == 1) & ~F.substring(clean, 3, 2).isin("00", "01", "99")


def matches(text: Column) -> Column:
    """All matches of the base patterns, right or not."""
    some = lambda found, needle: F.when(F.contains(text, F.lit(needle)), found).otherwise(F.array().cast(SPAN))
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), find_all(text, _CARD, "card")).otherwise(F.array().cast(SPAN))
    return F.concat(some(find_all(text, _EMAIL, "email"), "@"), find_all(text, _IP, "ip"), card, some(find_all(text, _PHONE, "phone"), "+"))


def is_right(s: Column) -> Column:
    """Whether a base match passes its kind's check."""
    kind, found = s["kind"], s["match"]
    return F.when(kind == "email", True).when(kind == "ip", _ip_ok(found)).when(kind == "card", _card_ok(found, 16, 19)).otherwise(_phone_ok(found))


def votes(s: Column, left: Column, right: Column) -> list[Column]:
    """The labelers' votes on a span with its surroundings, in the order of ``LABELERS``; the context's
    is only known once its words have been weighed."""
    kind, found = s["kind"], s["match"]
    base = kind.isin(*BASE)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    checked = F.when(base, is_right(s)).when(kind == "iban", iban_ok(found)).when(kind == "short_card", _card_ok(found, 14, 15)).when(kind == "ssn", ~found.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$"))
    speaks = F.lit(False)
    for k, words in GAZETTEER.items():
        speaks = speaks | ((kind == k) & left.rlike(rf"(?iu)(?<!\p{{L}})(?:{words})(?!\p{{L}})"))
    digits = _digits(found)
    flat = (F.length(digits) >= 7) & digits.rlike(r"^([0-9])\1+$|^0?123456789?0?")
    return [
        vote(base & is_right(s), base & ~is_right(s)),
        vote(checked, ~checked),
        vote(speaks, F.lit(False)),
        vote(F.lit(False), left.rlike(rf"(?i)(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})")),
        vote((F.length(digits) >= 9) & ~flat, flat),
        vote(right.rlike(r"^(?:$|[\s.,;:!?)#*%&$])"), left.rlike(r"[\p{L}0-9_/]$") | right.rlike(r"^[\p{L}0-9_/]")),
        F.lit(0),
    ]


def length_class(s: Column) -> Column:
    return F.least(F.floor(F.log2(F.length(s["match"]).cast("double"))), F.lit(7)).cast("int")


# --- fitting, on tables of bounded size --------------------------------------------------------


def expectation_maximisation(patterns: Sequence[tuple[tuple[str, tuple[int, ...]], int]], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior probabilities of vote patterns (kind, votes) with their numbers, by Dawid and Skene:
    each labeler has vote probabilities for either class, each kind a share. Starts from the votes
    weighed by ``FIRST_ODDS``."""
    post = {}
    for (kind, v), _ in patterns:
        post[kind, v] = 1 / (1 + math.exp(-sum(o * x for o, x in zip(FIRST_ODDS, v, strict=True))))
    for _ in range(rounds):
        share, seen = {}, {}
        table = [[{x: 1.0 for x in (-1, 0, 1)} for _ in LABELERS] for _ in (0, 1)]
        for key, n in patterns:
            p = post[key]
            share[key[0]] = share.get(key[0], 1.0) + n * p
            seen[key[0]] = seen.get(key[0], 2.0) + n
            for j, x in enumerate(key[1]):
                table[1][j][x] += n * p
                table[0][j][x] += n * (1 - p)
        # a vote for a class may not count against it: labelers are better than chance
        odds = []
        for j in range(len(LABELERS)):
            total = [sum(table[c][j].values()) for c in (0, 1)]
            o = {x: math.log(table[1][j][x] / total[1]) - math.log(table[0][j][x] / total[0]) for x in (-1, 0, 1)}
            odds.append({1: max(0.0, o[1]), 0: o[0] if abs(o[0]) < 1 else math.copysign(1, o[0]), -1: min(0.0, o[-1])})
        for key, _n in patterns:
            prior = math.log(share[key[0]] / (seen[key[0]] - share[key[0]]))
            post[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(odds[j][x] for j, x in enumerate(key[1]))))))
    return post


def features(kind: str, v: Sequence[int], size: int, evidence: int = 0) -> dict[str, float]:
    out = {f"kind={kind}": 1.0, f"size={size}": 1.0, f"evidence={evidence}": 1.0}
    for name, x in zip(LABELERS, v, strict=True):
        if x:
            out[f"{name}={x}"] = 1.0
    return out


def train_classifier(rows: Sequence[tuple[str, tuple[int, ...], int, int, int]], post: dict, rounds: int = 300) -> dict[str, float]:
    """Logistic weights by feature name, from (kind, votes, length class, evidence class, number) and posteriors."""
    names = sorted({f for k, v, s, e, _ in rows for f in features(k, v, s, e)})
    weights = dict.fromkeys(names, 0.0)
    total = sum(r[4] for r in rows) or 1
    data = [(features(k, v, s, e), post[k, v], n / total) for k, v, s, e, n in rows]
    for _ in range(rounds):
        slope = dict.fromkeys(names, 0.0)
        curve = dict.fromkeys(names, 0.0)
        for f, y, n in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[x] for x in f)))))
            for x in f:
                slope[x] += n * (y - p)
                curve[x] += n * p * (1 - p)
        for x in names:
            weights[x] += 0.3 * (slope[x] - 1e-5 * weights[x]) / (curve[x] + 1e-4)
    return weights


def context_words(left: Column) -> Column:
    """The distinct words of what stands before a span, in lower case; a word that the cut begins in doesn't count."""
    whole = F.when(F.length(left) < CONTEXT, left).otherwise(F.regexp_replace(left, r"^\p{L}+", ""))
    return F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit(r"\p{L}{2,}"), F.lit(0)))


def with_evidence(judged: DataFrame, post: dict[tuple[str, tuple[int, ...]], float]) -> DataFrame:
    """Candidates (row, s, votes, ...) with ``evidence``, the class of their context's summed evidence.

    A word's evidence for a kind is the log of its share among the kind's likely candidates over that
    among the unlikely ones, each candidate counted by its posterior. Words are counted over all
    candidates with a map-side combine; those of one kind are a bounded table.
    """
    spark = judged.sparkSession
    if not post:
        return judged.withColumn("evidence", F.lit(0))
    known = spark.createDataFrame([(k, list(v), float(p)) for (k, v), p in sorted(post.items())], "kind string, votes array<int>, p double")
    each = judged.select("row", "s.kind", "s.start", "votes", F.explode(context_words(F.col("s.left"))).alias("word"))
    # one row a vote pattern
    weighed = each.join(F.broadcast(known), ["kind", "votes"])
    seen = weighed.groupBy("kind", "word").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"), F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN)
    all_ = judged.select("s.kind", "votes").join(F.broadcast(known), ["kind", "votes"]).groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    share = lambda x, of: (F.col(x) + 0.5) / (F.col(of) + 1.0)
    words = cut(seen.join(F.broadcast(all_), "kind").withColumn("weight", F.log(share("yes", "all_yes") / share("no", "all_no"))).orderBy(F.desc("n"), "kind", "word").limit(WORDS).select("kind", "word", "weight"), "pii-words")
    # at most WORDS rows; an evidence that few candidates speak for is small by the added halves
    summed = each.join(F.broadcast(words), ["kind", "word"]).groupBy("row", "kind", "start").agg(F.round(F.sum("weight"), 6).alias("sum"))
    summed = summed.withColumnsRenamed({"row": "row_w", "kind": "kind_w", "start": "start_w"})
    joined_ = judged.join(summed, (F.col("row") == F.col("row_w")) & (F.col("s.kind") == F.col("kind_w")) & (F.col("s.start") == F.col("start_w")), "left")
    evidence = F.least(F.greatest(F.round(F.coalesce("sum", F.lit(0.0))), F.lit(-float(EVIDENCE))), F.lit(float(EVIDENCE))).cast("int")
    return joined_.withColumn("evidence", evidence).drop("row_w", "kind_w", "start_w", "sum")


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, base, added), a row for each row of ``docs``: arrays of (kind, start, end, match),
    positions in code points, end exclusive, sorted by kind and start. ``added`` has the candidates, apart from those that
    overlap a base span or lie in another one, to which the classifier gives ``threshold`` or more.

    A null text counts as empty; repeated rows each have their spans; no candidates, no fit. An
    empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.concat(matches(text), *[find_all(text, p, k) for k, p in _ADDED_PATTERNS.items()])
    found = docs.select(F.col(id_col).cast("long").alias("id"), bound(spans, lambda all_: with_surroundings(text, all_, CONTEXT)).alias("found"))
    # Written once: the texts are searched once, and each row has a number that stays.
    found = cut(found.withColumn("row", F.monotonically_increasing_id()), "pii-candidates")
    each = found.where(F.size("found") > 0).select("row", F.explode("found").alias("s"))
    judged = each.select("row", "s", F.array(*votes(F.col("s"), F.col("s.left"), F.col("s.right"))).alias("votes"), length_class(F.col("s")).alias("size"))
    judged = cut(judged.withColumn("strong", F.col("s.kind").isin(*BASE) & (F.col("votes")[0] == 1)), "pii-votes")
    patterns = lambda rows: sorted(((r[0], tuple(r[1])), r[2]) for r in rows.groupBy("s.kind", "votes").agg(F.count("*")).collect())
    judged = with_evidence(judged, expectation_maximisation(patterns(judged)))
    context = F.signum("evidence").cast("int")
    judged = cut(judged.withColumn("votes", F.concat(F.slice("votes", 1, len(LABELERS) - 1), F.array(context))), "pii-judged")
    post = expectation_maximisation(patterns(judged))
    counts = judged.groupBy("s.kind", "votes", "size", "evidence").agg(F.count("*").alias("n")).collect()
    weights = train_classifier(sorted((r[0], tuple(r[1]), r[2], r[3], r[4]) for r in counts), post)
    weight = F.create_map(*[F.lit(x) for pair in [("", 0.0), *sorted(weights.items())] for x in pair])
    of = lambda name: F.coalesce(F.try_element_at(weight, name), F.lit(0.0))
    logit = of(F.concat(F.lit("kind="), F.col("s.kind"))) + of(F.concat(F.lit("size="), F.col("size").cast("string"))) + of(F.concat(F.lit("evidence="), F.col("evidence").cast("string")))
    for j, name in enumerate(LABELERS):
        logit = logit + of(F.concat(F.lit(f"{name}="), F.col("votes")[j].cast("string")))
    score = 1 / (1 + F.exp(-logit))
    # What stands before and after a span in its text, in a pass in either order (frames grow by a row
    # at a time): an added span goes if a base span overlaps it or another added span holds it.
    order = Window.partitionBy("row").orderBy("s.start", F.desc("s.end"), "s.kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("s.start"), "s.end", F.desc("s.kind")).rowsBetween(Window.unboundedPreceding, -1)
    strong, added = F.col("strong"), ~F.col("strong") & F.col("s.kind").isin(*ADDED)
    kept = judged.where(strong | (added & (score >= threshold))).withColumns({
        "base_end": F.max(F.when(strong, F.col("s.end"))).over(before),
        "base_start": F.min(F.when(strong, F.col("s.start"))).over(after),
        "held_to": F.max(F.when(added, F.col("s.end"))).over(before),
    })
    clear = ~F.coalesce((F.col("base_end") > F.col("s.start")) | (F.col("base_start") < F.col("s.end")), F.lit(False)) & ~F.coalesce(F.col("held_to") >= F.col("s.end"), F.lit(False))
    plain = F.struct("s.kind", "s.start", "s.end", "s.match")
    kept = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.when(strong, plain))).alias("base"), F.sort_array(F.collect_list(F.when(added & clear, plain))).alias("added"))
    none = F.array().cast(SPAN)
    return found.select("row", "id").join(kept, "row", "left").select("id", F.coalesce(F.col("base").cast(SPAN), none).alias("base"), F.coalesce(F.col("added").cast(SPAN), none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of base spans and the list of all spans."""
    return found.select(
        F.col("id").alias("doc_id"),
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base"), KINDS, True).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS, True).alias("spans"),
    )
