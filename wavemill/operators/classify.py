"""Decisions with abstention: nearest class mean, and a linear score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import refuse
from ..functions.fixed import U64_MAX, dec, dec_tdiv, let, num, total

CONFIDENCE_MAX = 1000
_DECISION = "struct<kind:string,class:int,confidence_permille:int>"


def intent(label: Column, confidence: Column) -> Column:
    """A decision for a class; the confidence must not pass 1000."""
    ok = F.when(confidence <= CONFIDENCE_MAX, confidence).otherwise(F.raise_error(F.lit("InvalidConfidence")).cast("int"))
    return F.struct(F.lit("Intent").alias("kind"), label.cast("int").alias("class"), ok.cast("int").alias("confidence_permille"))


def no_intent() -> Column:
    return F.struct(F.lit("NoIntent").alias("kind"), F.lit(None).cast("int").alias("class"), F.lit(None).cast("int").alias("confidence_permille"))


def is_abstain(decision: Column) -> Column:
    return decision["kind"] == "NoIntent"


def decision_text(decision: Column) -> Column:
    return F.when(is_abstain(decision), "NoIntent").otherwise(F.concat(F.lit("Intent(class="), decision["class"], F.lit(", confidence_permille="), decision["confidence_permille"], F.lit(")")))


def distance_sq(feature: Column, mean: Column) -> Column:
    """Squared distance as a DECIMAL, saturated at 2**64 - 1; null if lengths differ."""
    d = lambda f, m: dec(f.cast("long") - m.cast("long"))
    squares = F.zip_with(feature, mean, lambda f, m: dec(d(f, m) * d(f, m)))
    return F.when(F.size(feature) == F.size(mean), F.least(total(squares, num(0)), num(U64_MAX)))


def classify_mdm(feature: Column, class_means: Column | list[list[int]], abstain_below: int = 0) -> Column:
    """The nearest class mean; ties go to the lower class. Null if a length differs.

    ``class_means`` is a list or an array column, of 256 classes at most.
    """
    if isinstance(class_means, list):
        refuse(not class_means, "EmptyClassSet")
        refuse(len(class_means) > 256, "DimensionMismatch")
        class_means = F.array(*(F.array(*(F.lit(v) for v in m)) for m in class_means))

    def decided(order: Column) -> Column:
        first = F.get(order, F.lit(0))
        second = F.coalesce(F.get(order, F.lit(1))["d"], num(U64_MAX))

        def of(conf: Column) -> Column:
            return F.when(conf < abstain_below, no_intent()).otherwise(intent(first["i"], conf))

        both = dec(second + first["d"])
        conf = F.when(both == 0, 0).otherwise(dec_tdiv(dec(dec(second - first["d"]) * num(CONFIDENCE_MAX)), F.when(both != 0, both)).cast("int"))
        return let(conf, of)

    order = F.array_sort(F.transform(class_means, lambda m, i: F.struct(distance_sq(feature, m).alias("d"), i.alias("i"))))
    fits = F.forall(class_means, lambda m: F.size(m) == F.size(feature)) & (F.size(class_means) > 0)
    return F.when(fits, let(order, decided))


def lda_score(feature: Column, weights: Column | list[int], bias: Column | int = 0) -> Column:
    """The linear score, saturated to 64 bits; null if lengths differ."""
    weights = F.array(*(F.lit(w) for w in weights)) if isinstance(weights, list) else weights
    bias = num(bias) if isinstance(bias, int) else dec(bias)
    products = F.zip_with(feature, weights, lambda f, w: dec(dec(f) * dec(w)))
    return F.when(F.size(feature) == F.size(weights), F.greatest(F.least(total(products, bias), num(2**63 - 1)), num(-(2**63))).cast("long"))


def classify_lda_binary(feature: Column, weights: Column | list[int], bias: Column | int = 0, abstain_band: int = 0) -> Column:
    """Class 1 from a score of 0 on, class 0 below; no intent strictly inside the band."""
    refuse(abstain_band < 0, "InvalidThreshold")

    def of(s: Column) -> Column:
        a = F.abs(dec(s))
        conf = dec_tdiv(dec(a * num(CONFIDENCE_MAX)), dec(a + num(max(abstain_band, 1)))).cast("int")
        return F.when(s.isNull(), F.lit(None).cast(_DECISION)).when(a < num(abstain_band), no_intent()).otherwise(intent(F.when(s >= 0, 1).otherwise(0), conf))

    return let(lda_score(feature, weights, bias), of)
