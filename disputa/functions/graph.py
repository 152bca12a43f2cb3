"""Column expressions over argument graphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from disputa.functions import vocab


def is_relation(kind: Column) -> Column:
    return kind.isin(vocab.RELATION_TYPES)


def allowed_edge(source: Column, target: Column) -> Column:
    """Whether the metamodel has edges from one node type to another; null types are not allowed."""
    rel = is_relation(target)
    shape = F.when(source == "I", rel).when(is_relation(source) | (source == "YA"), (target == "I") | rel).when(source == "L", target.isin("YA", "TA")).when(source == "TA", target.isin("L", "YA"))
    return F.coalesce(shape, F.lit(False))


def edge_kind(source: Column, target: Column) -> Column:
    """The name of an edge by the types of its ends; null without one."""
    return (
        F.when(source.isin("L", "TA") & (target == "YA"), "ANCHORS")
        .when(source == "YA", "ILLOCUTES")
        .when((source == "I") & (target == "RA"), "PREMISE_OF")
        .when(source == "RA", "CONCLUDES")
        .when((source == "I") & (target == "CA"), "CONFLICTS_VIA")
        .when(source == "CA", "CONFLICTS_WITH")
        .when((source == "I") & (target == "MA"), "REPHRASES_VIA")
        .when(source == "MA", "REPHRASES_TO")
        .when((source == "L") & (target == "TA"), "NEXT")
        .when((source == "TA") & (target == "L"), "LEADS_TO")
    )


def relation_kind(kind: Column) -> Column:
    return F.when(kind == "RA", "support").when(kind == "CA", "attack").when(kind == "MA", "rephrase")


def family(force: Column) -> Column:
    out = F.lit("other")
    for name, forces in vocab.FAMILIES.items():
        out = F.when(force.isin(forces), name).otherwise(out)
    return out


def node_cost(kind: Column, weights: Column) -> Column:
    """Cost of deleting or inserting a node under a named weight setting."""
    out = F.lit(1.0)
    for name, costs in vocab.NODE_COST.items():
        for node_type, cost in costs.items():
            out = F.when((weights == name) & (kind == node_type), cost).otherwise(out)
    return out


def substitution_cost(type_a: Column, type_b: Column, scheme_a: Column, scheme_b: Column, cosine: Column) -> Column:
    same = type_a == type_b
    return (
        F.when(same & type_a.isin("I", "L"), F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))
        .when(same & (type_a == "YA"), F.when(scheme_a == scheme_b, 0.0).when(family(scheme_a) == family(scheme_b), vocab.FAMILY_MATCH).otherwise(vocab.FORCE_MISMATCH))
        .when(same, 0.0)
        .when(is_relation(type_a) & is_relation(type_b), vocab.RELATION_MISMATCH)
        .otherwise(vocab.FORBIDDEN)
    )


def distance_band(distance: Column) -> Column:
    return F.when(distance <= 1, "1").when(distance <= 4, "2-4").when(distance <= 9, "5-9").when(distance.isNotNull(), "10+")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for vectors of different lengths or zero norm."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), product(a, b) / norm).otherwise(0.0)


def substitution_basis(cosine: Column) -> list[Column]:
    """The four increments of the piecewise-linear substitution function."""
    k = vocab.KNOTS
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(k[i]) - cosine) / (k[i] - k[i + 1]))) for i in range(4)]


def speaker_of(speaker: Column, text: Column) -> Column:
    """The speaker, or what stands before ' : ' if that begins before byte 60."""
    head = F.substring_index(text, " : ", 1)
    prefix = F.when((F.instr(text, " : ") > 1) & (F.octet_length(head) < 60), F.trim(head)).otherwise("")
    return F.when(F.coalesce(speaker, F.lit("")) != "", speaker).otherwise(prefix)


def locution_text(text: Column) -> Column:
    """A locution without its speaker's prefix."""
    prefixed = (F.instr(text, " : ") > 1) & (F.octet_length(F.substring_index(text, " : ", 1)) < 60)
    return F.trim(F.when(prefixed, F.substr(text, F.instr(text, " : ") + F.lit(3))).otherwise(text))


def truncated(text: Column, size: int = 80) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def precision_recall(tp: Column, predicted: Column, gold: Column, prefix: str = "") -> list[Column]:
    """precision, recall and f1, each 0 where its denominator is."""
    zero = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    return [zero(tp, predicted).alias(f"{prefix}precision"), zero(tp, gold).alias(f"{prefix}recall"), zero(2.0 * tp, predicted + gold).alias(f"{prefix}f1")]


def condition_label(condition: Column, prompts: Column, model: Column) -> Column:
    """condition@prompts/model, the model without its family's prefix; the baseline has neither."""
    tag = F.regexp_replace(model, "^gpt-", "")
    return F.when(condition == "baseline", condition).otherwise(F.concat(condition, F.lit("@"), prompts, F.lit("/"), tag))


def hash_vector(text: Column, size: int = 16) -> Column:
    """A unit vector of floats made of SHA-256 of the text and each place as four little-endian bytes."""
    word = lambda j: F.substring(F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit(j.to_bytes(4, "little").hex()))), 256), 1, 8)
    turned = lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))
    values = F.array(*(F.conv(turned(word(j)), 16, 10).cast("double") / 4294967295.0 * 2 - 1 for j in range(size)))
    once = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))
    unit = lambda vs, n: F.transform(vs, lambda v: F.when(n > 0, v.cast("float").cast("double") / n).otherwise(v).cast("float"))
    return once(values, lambda vs: once(F.sqrt(F.aggregate(vs, F.lit(0.0), lambda s, v: s + v * v)), lambda n: unit(vs, n)))
