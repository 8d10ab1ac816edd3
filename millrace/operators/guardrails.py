"""Rules over texts: injection and personal-data guards, tiers, anchors, output scope."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whole

# Patterns of the input guard, in order.
INJECTION = [
    r"(?iu)ignore\s+(previous|prior|all|the)\s+(instructions?|prompts?|rules?)",
    r"(?iu)ignora(r)?\s+(todas?\s+)?(las?\s+)?(instrucciones|reglas|[oó]rdenes|prompts?)(\s+(anteriores|previas|dadas))?",
    r"(?iu)</?\s*(system|instructions?|prompt)\s*>",
    r"(?iu)new\s+instructions?\s*[:.\-]",
    r"(?iu)nuevas?\s+instrucciones\s*[:.\-]",
    r"(?iu)forget\s+(everything|all|previous)",
    r"(?iu)olvida\s+(todo|todas\s+las\s+instrucciones|lo\s+anterior)",
    whole(r"you\s+are\s+now"),
    whole(r"ahora\s+(eres|act[uú]as?\s+como)"),
    whole(r"disregard") + r"(?s:.{0,40})\b(instructions?|prompts?|rules?|context|previous|prior)",
    whole(r"desestima|haz\s+caso\s+omiso") + r"(?s:.{0,40})\b(instrucciones|reglas|contexto|prompt|anterior(es)?|previ[ao]s?)",
]
# Personal data that a request may not hold, in order.
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"),
    ("phone", r"(?:\+\d{1,3}[\s.-]?)?(?:\d[\s.-]?){9,12}\d"),
]
# Words that decide the tier.
NDA = [whole(r"nda|non[- ]?disclosure|confidential|under embargo|legal hold"), whole(r"acuerdo\s+de\s+confidencialidad|confidencial|bajo\s+secreto|retenci[oó]n\s+legal")]
REGULATORY = [whole(r"hipaa|gdpr|rgpd|sox|pci[- ]?dss|fda|iso[- ]?27001|ccpa|lopd")]
TECHNICAL = r"(?iu)\b(docker|kubernetes|k8s|microservice|microservices|microservicio|microservicios|terraform|iac|helm|grpc|graphql|kafka|airflow|spark|rabbitmq)\b"
# Rules for statements that must not be forgotten.
ANCHORS = [
    ("nda", r"nda|non[- ]?disclosure|under embargo|legal hold"),
    ("nda", r"acuerdo\s+de\s+confidencialidad|bajo\s+secreto|retenci[oó]n\s+legal"),
    ("signed_contract", r"(signed|countersigned)\s+(the\s+)?(contract|sow|msa|agreement)"),
    ("signed_contract", r"(contrato|acuerdo)\s+(firmado|refrendado)|hemos\s+firmado\s+el\s+(contrato|acuerdo)"),
    ("scope_frozen", r"(scope|backlog)\s+(is\s+)?(frozen|locked|final|fixed)"),
    ("scope_frozen", r"(alcance|backlog)\s+(est[aá]\s+)?(congelado|cerrado|bloqueado|fijado)"),
    ("budget_locked", r"(budget|cap|ceiling)\s+(is\s+)?(locked|fixed|approved|capped)\s+at"),
    ("budget_locked", r"(presupuesto|tope)\s+(est[aá]\s+)?(bloqueado|fijado|aprobado|limitado)\s+en"),
    ("compliance", r"hipaa|gdpr|rgpd|sox|pci[- ]?dss|fda|iso[- ]?27001|lopd"),
    ("deadline_hard", r"hard\s+deadline|must\s+go\s+live\s+by"),
    ("deadline_hard", r"fecha\s+l[ií]mite\s+estricta|debe\s+estar\s+en\s+producci[oó]n\s+antes\s+de"),
    ("contractual", r"contractually\s+(bound|required|obliged)"),
    ("contractual", r"contractualmente\s+(obligad[oa]|vinculad[oa])"),
    ("explicit_commitment", r"(we|the (client|customer))\s+(agreed|committed)\s+to"),
    ("explicit_commitment", r"acordamos|nos\s+comprometimos\s+a|el\s+cliente\s+acept[oó]"),
]


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(text.rlike(p), F.lit(False))
    return out


# A part that every match of the injection pattern at this place has in lower case (of letters that
# only have one lower-case form), so that most texts are told by a search for bytes.
_PARTS = ["gnor", "gnora", "<", "new", "nueva", "forget", "olv", "you", "ahora", "regard", ("ma", "haz")]


def injection_match(text: Column) -> Column:
    """The first injection pattern's first match, at most 80 characters; null if none matches."""
    low = F.lower(text)

    def found(pattern: str, parts: str | tuple[str, ...]) -> Column:
        some = F.lit(False)
        for p in (parts,) if isinstance(parts, str) else parts:
            some = some | F.contains(low, F.lit(p))
        return F.when(some, F.regexp_substr(text, F.lit(pattern)))

    return F.left(F.coalesce(*[found(p, q) for p, q in zip(INJECTION, _PARTS, strict=True)]), F.lit(80))


def personal_kind(text: Column) -> Column:
    """The first kind of personal data that a text holds; e-mail addresses are only looked for where there is an @."""
    return F.coalesce(*[F.when(F.contains(text, F.lit("@")) & text.rlike(p) if k == "email" else text.rlike(p), k) for k, p in PERSONAL])


def guard(text: Column, flagged: Column | None = None) -> Column:
    """Why a request is turned away: moderation, then injection, then personal data; null if it passes.
    Without a moderation verdict that layer lets it pass."""
    moderated = F.when(F.coalesce(flagged, F.lit(False)), "moderation") if flagged is not None else F.lit(None).cast("string")
    return F.coalesce(moderated, F.when(injection_match(text).isNotNull(), "injection"), F.concat(F.lit("pii:"), personal_kind(text)))


def technical_words(text: Column) -> Column:
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TECHNICAL), F.lit(1)), F.lower)))


#: A tier's rule: its name, the tier, and what says of (text, scope, technologies, team) whether it holds.
TierRule = tuple[str, str, Callable[[Column, Column, Column, Column], Column]]
TIER_RULES: list[TierRule] = [
    ("nda", "confidential", lambda text, scope, technologies, team: _any(text, NDA) | _any(scope, NDA)),
    ("regulatory", "regulated", lambda text, scope, technologies, team: _any(text, REGULATORY) | _any(scope, REGULATORY) | _any(F.array_join(technologies, " "), REGULATORY)),
    ("technical", "developer", lambda text, scope, technologies, team: technical_words(text) >= 2),
    ("small_team", "small", lambda text, scope, technologies, team: team <= 2),
]


def tier(text: Column, scope: Column, technologies: Column, team: Column, rules: Sequence[TierRule] = tuple(TIER_RULES)) -> Column:
    """(tier, rule) of the first rule that holds; a rule that can't be judged is skipped."""
    out = F.struct(F.lit("standard").alias("tier"), F.lit("default").alias("rule"))
    for name, of, holds in reversed(rules):
        out = F.when(F.coalesce(holds(text, scope, technologies, team), F.lit(False)), F.struct(F.lit(of).alias("tier"), F.lit(name).alias("rule"))).otherwise(out)
    return out


def anchor_rules(text: Column) -> Column:
    """Names of the anchor rules that match, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(whole(p)), n) for n, p in ANCHORS])))


def is_anchor(text: Column, judged: Column | None = None) -> Column:
    """Whether a statement is one to keep: as a model has judged it, and by the rules where it hasn't (null)."""
    by_rule = F.size(anchor_rules(F.coalesce(text, F.lit("")))) > 0
    return by_rule if judged is None else F.coalesce(judged, by_rule)


#: The one phase of an answer that sizes nothing, and the longest summary.
PLACEHOLDER = ("Not estimated", 1, 0, "Scope, integrations and team must be known to size this.")
SUMMARY_CHARS, QUOTED_CHARS = 1200, 400


def scope_output(df: DataFrame, threshold: int = 30, prefix: str = "Out of scope:", reason: str = "") -> DataFrame:
    """Rewrites answers of low confidence (columns confidence, summary, weeks, cost and, if there are any,
    phases) that don't say so: the summary tells why and quotes the old one, one placeholder phase of no
    cost stands for all. A null summary is empty."""
    summary = F.coalesce("summary", F.lit(""))
    low = (F.col("confidence") < threshold) & ~F.startswith(summary, F.lit(prefix))
    told = F.left(F.concat(F.lit(f"{prefix} {reason}"), F.left(summary, F.lit(QUOTED_CHARS))), F.lit(SUMMARY_CHARS))
    out = {"rewritten": low, "summary": F.when(low, told).otherwise(F.col("summary")), "weeks": F.when(low, 1).otherwise(F.col("weeks")), "cost": F.when(low, 0).otherwise(F.col("cost"))}
    if "phases" in df.columns:
        kind = df.schema["phases"].dataType
        only = F.array(F.struct(*[F.lit(v) for v in PLACEHOLDER])).cast(kind)
        out["phases"] = F.when(low, only).otherwise(F.col("phases"))
    return df.withColumns(out)
