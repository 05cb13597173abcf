"""Relation predictions: a piecewise convolutional encoder with attention over a bag, gates, and triples from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words for study, and words for places.
STUDY_WORDS = ("学习", "就读", "毕业", "入学", "在校", "攻读")
PLACE_WORDS = ("国籍", "公民", "国家", "位于", "在", "来自", "出生", "生于", "逝世", "去世", "定居", "居住", "地点")
STUDY_VETO = ("P108", "P1416")
#: The kind that a property's object must have.
RANGES = {
    "Location": ("P19", "P20", "P27", "P551", "P17", "P276"),
    "Organization": ("P69", "P108", "P1416", "P361", "P127", "P137"),
    "Award": ("P166",),
    "Concept": ("P800", "P279", "P31"),
}
PLACE_PROPS = RANGES["Location"]
TAU = 0.5
#: Bags of each label that a network is trained on at most; they are gathered in the driver. Predictions are made of all bags.
TRAIN_BAGS = 100


class Encoder:
    """Characters to bag scores: embeddings, a convolution of width 3, maxima of three pieces, attention for each class."""

    def __init__(self, labels: list[str], vocab: int, dim: int = 32, filters: int = 32, hidden: int = 64, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.1, (vocab, dim)).astype(np.float32)
        self.embed[0] = 0
        self.conv = rng.normal(0, 0.1, (3 * dim, filters)).astype(np.float32)
        self.hidden = rng.normal(0, 0.1, (3 * filters, hidden)).astype(np.float32)
        self.query = rng.normal(0, 0.1, (len(labels), hidden)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (len(labels), hidden)).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def encode(self, ids: np.ndarray, e1: np.ndarray, e2: np.ndarray) -> np.ndarray:
        x = self.embed[ids]
        pad = np.pad(x, ((0, 0), (1, 1), (0, 0)))
        h = np.maximum(np.concatenate([pad[:, :-2], pad[:, 1:-1], pad[:, 2:]], -1) @ self.conv, 0)
        pos = np.arange(ids.shape[1])[None, :, None]
        a, b = e1[:, None, None], e2[:, None, None]
        pieces = [np.where(m & (ids > 0)[:, :, None], h, 0).max(1) for m in (pos <= a, (pos > a) & (pos <= b), pos > b)]
        return np.tanh(np.concatenate(pieces, -1) @ self.hidden)

    def encode_all(self, ids: np.ndarray, e1: np.ndarray, e2: np.ndarray, step: int = 64) -> np.ndarray:
        """encode in steps, so a bag of many instances takes no more memory than one step; padding changes nothing."""
        return np.concatenate([self.encode(ids[i:i + step], e1[i:i + step], e2[i:i + step]) for i in range(0, len(ids), step)])

    def bag(self, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class probabilities, attention of each class over the instances)."""
        att = self.query @ reps.T
        att = np.exp(att - att.max(1, keepdims=True))
        att /= att.sum(1, keepdims=True)
        z = ((att @ reps) * self.out).sum(1) + self.bias
        p = np.exp(z - z.max())
        return p / p.sum(), att


def train(encoder: Encoder, bags: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 15, rate: float = 0.05) -> Encoder:
    """Fits the output layer to labelled bags (a bounded sample, gathered by the caller) over the encoder's features, with
    class weights that are the inverse of their share, between 0.5 and 20."""
    feats = [encoder.encode_all(ids, e1, e2).mean(0) for ids, e1, e2, _ in bags]
    x, y = np.array(feats), np.array([b[3] for b in bags])
    share = np.bincount(y, minlength=len(encoder.labels)) / max(len(y), 1)
    weight = np.clip(1 / np.maximum(share * len(encoder.labels), 1e-6), 0.5, 20)
    for _ in range(epochs * 20):
        z = x @ encoder.out.T + encoder.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[y][:, None] / len(y)
        encoder.out -= rate * 20 * p.T @ x
        encoder.bias -= rate * 20 * p.sum(0)
    return encoder


def tensors(bags: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """bag_id, ids, e1, e2 of bags (bag_id, texts array<string>, e1, e2): whole sentences by the vocabulary (1 for other
    characters), padded to the longest of the bag."""
    shared = bags.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            ids = []
            for texts in batch.column("texts").to_pylist():
                size = max(map(len, texts), default=0)
                ids.append([[known.get(c, 1) for c in t] + [0] * (size - len(t)) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("bag_id"), pa.array(ids, pa.list_(pa.list_(pa.int32()))), batch.column("e1"), batch.column("e2")], ["bag_id", "ids", "e1", "e2"])

    return bags.select("bag_id", "texts", "e1", "e2").mapInArrow(run, "bag_id string, ids array<array<int>>, e1 array<int>, e2 array<int>")


def sample(labelled: DataFrame, most: int = TRAIN_BAGS) -> DataFrame:
    """bag_id, label: at most so many bags of each label, by hash order."""
    order = Window.partitionBy("label").orderBy(F.sha1("bag_id"), "bag_id")
    return labelled.select("bag_id", "label").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


PREDICTED = "bag_id string, predicted_label string, predicted_prob double, top_instance int, top_score double, class_probs array<struct<label:string,score:double>>"


def predict(tensors: DataFrame, encoder: Encoder) -> DataFrame:
    """Predictions of bags. tensors: bag_id, ids array<array<int>>, e1 array<int>, e2 array<int>."""
    shared = tensors.sparkSession.sparkContext.broadcast(encoder)

    def run(batches):
        model = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for bag, ids, e1, e2 in zip(*(batch.column(c).to_pylist() for c in ("bag_id", "ids", "e1", "e2")), strict=True):
                if not ids:
                    continue
                p, att = model.bag(model.encode_all(np.array(ids), np.array(e1), np.array(e2)))
                top = int(p.argmax())
                best = int(att[top].argmax())
                row = (bag, model.labels[top], float(p[top]), best, float(att[top, best]), [{"label": n, "score": float(v)} for n, v in zip(model.labels, p, strict=True)])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split(" ")[0] for f in ("bag_id", "predicted_label", "predicted_prob", "top_instance", "top_score", "class_probs")])

    return tensors.select("bag_id", "ids", "e1", "e2").mapInArrow(run, PREDICTED)


def above_threshold(predictions: DataFrame, taus: dict[str, float] | None = None, default: float = TAU) -> DataFrame:
    """Predictions other than NA that reach the threshold of their seed type."""
    tau = F.lit(default)
    for kind, t in (taus or {}).items():
        tau = F.when(F.col("seed_type") == kind, t).otherwise(tau)
    return predictions.filter((F.col("predicted_label") != "NA") & (F.col("predicted_prob") >= tau))


def above_threshold_by_label(predictions: DataFrame, taus: dict[str, float] | None = None, default: float = 0.75) -> DataFrame:
    """The older form: every label whose own score reaches its threshold. predictions: class_probs."""
    tau = F.lit(default)
    for prop, t in (taus or {}).items():
        tau = F.when(F.col("label") == prop, t).otherwise(tau)
    each = predictions.select("*", F.explode("class_probs").alias("p")).withColumn("label", F.col("p.label")).withColumn("score", F.col("p.score")).drop("p")
    return each.filter((F.col("label") != "NA") & (F.col("score") >= tau))


def in_space(predictions: DataFrame, spaces: DataFrame) -> DataFrame:
    """Predictions whose property is allowed for their seed type. spaces: seed_type, prop_id."""
    return predictions.join(F.broadcast(spaces.select("seed_type", F.col("prop_id").alias("predicted_label")).distinct()), ["seed_type", "predicted_label"], "left_semi")


def range_fits(predictions: DataFrame, object_labels: DataFrame, ranges: dict[str, tuple[str, ...]] = RANGES) -> DataFrame:
    """Predictions whose object has the kind that the property asks for; other properties pass. object_labels: id, labels."""
    need = F.lit("")
    for kind, props in ranges.items():
        need = F.when(F.col("predicted_label").isin(*props), kind).otherwise(need)
    both = predictions.join(object_labels.select(F.col("id").alias("object_qid"), "labels"), "object_qid", "left")
    return both.withColumn("need", need).filter((F.col("need") == "") | F.array_contains(F.coalesce("labels", F.array().cast("array<string>")), F.col("need"))).drop("need", "labels")


def text_fits(predictions: DataFrame, schema: DataFrame, sentence: str = "top_sentence") -> DataFrame:
    """Predictions whose sentence states the relation: not empty, no study word for work, a place word for places, and one
    of the property's aliases, its parts in order; properties without aliases pass. schema: prop_id, aliases_zh."""
    t = F.coalesce(F.col(sentence), F.lit(""))
    has = lambda words: F.size(T.hits(t, F.array(*[F.lit(w) for w in words]))) > 0
    both = predictions.join(F.broadcast(schema.select(F.col("prop_id").alias("predicted_label"), "aliases_zh")), "predicted_label", "left")
    study = F.col("predicted_label").isin(*STUDY_VETO) & has(STUDY_WORDS)
    place = ~F.col("predicted_label").isin(*PLACE_PROPS) | has(PLACE_WORDS)
    alias = F.coalesce(F.size("aliases_zh"), F.lit(0)) <= 0
    stated = alias | F.exists("aliases_zh", lambda a: T.slots_in_order(t, a))
    return both.filter((t != "") & ~study & place & stated).drop("aliases_zh")


def best_of_each(predictions: DataFrame, evidence: int = 8) -> DataFrame:
    """One row for each statement: the highest score (the first row on a tie), how many rows and different texts it has, and
    the first of those texts in order, at most so many; texts are made distinct and cut before they are gathered."""
    keys = ["subject_qid", "object_qid", "prop_id"]
    named = predictions.withColumn("prop_id", F.col("predicted_label"))
    order = F.struct(-F.col("predicted_prob"), "row_id")
    best = named.groupBy(*keys).agg(F.max("predicted_prob").alias("score"), F.min_by(F.struct("seed_id", "seed_type", "source_url", "citation_key", "top_sentence", "row_id"), order).alias("best"), F.count("*").alias("n"))
    once = named.filter("top_sentence is not null").select(*keys, "top_sentence").distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("top_sentence"))
    texts = once.groupBy(*keys).agg(F.count("*").alias("texts"))
    cut = once.withColumn("nth", nth).filter(F.col("nth") <= evidence).groupBy(*keys).agg(F.array_sort(F.collect_list("top_sentence")).alias("evidence"))
    return best.join(texts, keys, "left").join(cut, keys, "left").withColumn("texts", F.coalesce("texts", F.lit(0))).withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def prop_labels(schema: DataFrame) -> DataFrame:
    """prop_id, shown: the label that a property is shown by: the Chinese one, else the English one, else itself."""
    shown = F.coalesce(F.nullif(F.trim("label_zh"), F.lit("")), F.nullif(F.trim("label"), F.lit("")), F.col("prop_id"))
    return schema.groupBy("prop_id").agg(F.min(shown).alias("shown"))


def prediction_triples(predictions: DataFrame, schema: DataFrame, taus: dict[str, float] | None = None, default: float = TAU) -> DataFrame:
    """The eighteen columns of a triple for every prediction above its threshold, which is applied anew: it may have changed
    since the prediction was made. predictions: the evidence laid flat; a missing sentence index gives an empty text."""
    tau = F.lit(default)
    for kind, t in (taus or {}).items():
        tau = F.when(F.col("seed_type") == kind, t).otherwise(tau)
    kept = above_threshold(predictions, taus, default).join(F.broadcast(prop_labels(schema)), F.col("predicted_label") == F.col("prop_id"), "left")
    text, model = F.coalesce("top_sentence", F.lit("")), F.coalesce(F.nullif("model", F.lit("")), F.lit("pcnn_mil"))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    score = F.format_string("%.4f", F.col("predicted_prob"))
    at = F.when(F.col("top_sentence_idx") >= 0, F.col("top_sentence_idx").cast("string")).otherwise("")
    return kept.select(
        none("subject_qid").alias("subject_qid"), none("seed_id").alias("seed_id"), none("subject_qid").alias("seed_qid"), F.coalesce(at, F.lit("")).alias("sentence_idx"), score.alias("relevance_score"),
        F.to_json(F.struct(none("bag_id").alias("bag_id"), F.lit(True).alias("mil"), tau.alias("tau"))).alias("reasons"), F.substring(text, 1, 500).alias("evidence_sentence"),
        F.coalesce("shown", "predicted_label").alias("predicate"), F.col("predicted_label").alias("predicate_prop_id"), F.lit("").alias("object_mention"), none("object_qid").alias("object_qid"),
        F.lit("0").alias("object_is_literal"), F.lit("").alias("ner_label"), score.alias("link_score"), none("citation_key").alias("citation_key"), none("source_url").alias("source_url"),
        F.concat(F.lit("["), model, F.lit("] "), F.substring(text, 1, 400)).alias("snippet"), F.concat(model, F.lit(":"), "predicted_label").alias("extraction_method"),
    )


def prediction_edges(predictions: DataFrame, schema: DataFrame, spaces: DataFrame, object_labels: DataFrame, facts: DataFrame, taus: dict[str, float] | None = None, default: float = TAU) -> DataFrame:
    """Statements of predictions that pass all gates (threshold, allowed properties, kind of object, what the sentence says),
    each once with its best score and its evidence, and whether facts (subject, prop_id, target_qid) hold the same."""
    kept = in_space(above_threshold(predictions, taus, default), spaces)
    return with_support(best_of_each(text_fits(range_fits(kept, object_labels), schema)), facts)


def with_support(statements: DataFrame, facts: DataFrame) -> DataFrame:
    """Statements with a flag whether facts (subject, prop_id, target_qid) hold the same."""
    known = facts.select(F.col("subject").alias("subject_qid"), F.col("target_qid").alias("object_qid"), "prop_id").distinct().withColumn("known", F.lit(1))
    return statements.join(known, ["subject_qid", "object_qid", "prop_id"], "left").withColumn("is_supporting_fact", F.coalesce("known", F.lit(0))).drop("known")
