"""License scans: a trained paragraph classifier, in DataFrame functions alone.

A paragraph is a line; of a wrapped licence text each line is judged on its own. Its features are its distinct words (A to
Z folded, runs of letters, digits, dots and dashes) and word pairs. A multinomial logistic regression with an L1 penalty
tells licence families from the unknown class. It is trained here: on phrases that name a family, made from a table of
phrases and a table of names, and on the wording of public licences (`license_texts`) whole, by sentence and in windows
of a dozen words. Unknown is learned from a bounded sample of corpus paragraphs, and from the wording and names of
licences outside the families, so that licence wording as such is no sign of a family.

The unknown class is calibrated on texts that a first fit has not seen: whole phrases and whole licence paragraphs are
held out, not rows of them. There the scores' temperature is chosen by likelihood, and the limit is the probability that
only one in a hundred held-out rows of the unknown class exceeds. The fit is then made on all.

A prediction is confirmed by wording: words are weighted by how few licence texts have them; a template of the family
must have enough of its weight in the paragraph, or the paragraph of its own in a licence text, and no text or name of
another family, or of a licence outside them, may fit as well.

Weights are few, so a paragraph is scored where it is and nothing is shuffled. Most paragraphs are not even scored: for
each family, the words without which no paragraph can reach the limit follow from the weights, and a paragraph with none
of them is unknown.

Null and empty texts have no paragraphs. Very long texts are only split into lines. Repeated rows each give their own
rows. Of equally likely families the first in order counts. Other columns are not read, so their names cannot clash. An
empty table leaves the licences alone to train on, and the result empty.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import license_texts

#: How texts name a licence; {} is the name.
PHRASES = (
    "Licensed under {}.", "Released under {}.", "Distributed under the terms of {}.", "This project is licensed under {}.", "This work is licensed under {}.",
    "This file is available under {}, see the LICENSE file for details.", "Use of this source code is governed by {}.", "The code is covered by {}.",
)
#: Names of each family.
TITLES = {
    "MIT": ("the MIT License", "the MIT license (MIT)", "an MIT license"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "GPL": ("the GNU General Public License, version 3", "the GNU General Public License v2", "the GPL version 2", "GPLv3"),
    "LGPL": ("the GNU Lesser General Public License, version 2.1", "the LGPL", "LGPLv3"),
    "AGPL": ("the GNU Affero General Public License, version 3", "the AGPL", "AGPLv3"),
    "BSD": ("the BSD License", "the 3-clause BSD license", "a BSD-style license"),
    "MPL-2.0": ("the Mozilla Public License, v. 2.0", "the MPL 2.0"),
    "CC-BY": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "public-domain": ("CC0 1.0", "the Unlicense", "a public domain dedication"),
    "all-rights-reserved": (),
}
#: Other short public notices of each family.
NOTICES = {
    "MIT": ("This project is MIT licensed.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("SPDX-License-Identifier: Apache-2.0",),
    "GPL": ("SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL": ("SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL": ("SPDX-License-Identifier: AGPL-3.0-only",),
    "BSD": ("SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": ("SPDX-License-Identifier: MPL-2.0",),
    "CC-BY": ("SPDX-License-Identifier: CC-BY-4.0",),
    "CC-BY-SA": ("SPDX-License-Identifier: CC-BY-SA-4.0",),
    "CC-BY-NC": ("SPDX-License-Identifier: CC-BY-NC-4.0",),
    "public-domain": ("This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: CC0-1.0"),
    "all-rights-reserved": (
        "All rights reserved.", "Copyright the authors. All rights reserved.",
        "Copyright 2020 by the publisher, all rights reserved worldwide.",
        "No part may be reproduced without written permission of the publisher.",
        "No part of this publication may be reproduced, stored or transmitted without the prior written permission of the publisher.",
    ),
}
FAMILIES = tuple(NOTICES)
#: Words of a window of a longer text.
WINDOW = 12
UNKNOWN = len(FAMILIES)
#: What is between words, in small letters.
CUT = r"[^a-z0-9.-]+|[a-z0-9.-]*[a-z0-9]-$|[.-]+(?=[^a-z0-9.-]|$)"
#: A paragraph of fewer distinct words is not held against whole licence texts.
LEAST_WORDS = 6
#: Temperatures that calibration tries, and the largest limit.
TEMPERATURES = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.4, 1.7, 2.0, 2.5, 3.0, 4.0)
MOST_LIMIT = 0.8
#: The share of held-out rows of the unknown class that stay below the limit.
MOST_FALSE = 0.99
#: Words in more than this share of ordinary paragraphs are no features.
MOST_USUAL = 0.002


def words(text: Column) -> Column:
    """Words of a paragraph in order; dots and dashes at their ends do not count. A last word that a dash cuts is left out."""
    plain = F.regexp_replace(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), CUT, " ",
    )
    return F.filter(F.split(F.trim(plain), " +"), lambda w: w != "")


def features(tokens: Column) -> Column:
    pairs = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(tokens), F.lit(2))), lambda i: F.concat_ws("_", F.get(tokens, i - 2), F.get(tokens, i - 1)),
    )
    return F.array_distinct(F.concat(tokens, F.when(F.size(tokens) >= 2, pairs).otherwise(F.array().cast("array<string>"))))


def once(value: Column, name: str) -> Column:
    """The value in a column of its own, which no later filter or projection computes again."""
    return F.explode(F.array(value)).alias(name)


def constant(values: Iterable[object], kind: str) -> Column:
    """Many values as one constant array: a single text in the plan, which the optimiser splits once."""
    return F.split(F.lit("\n".join(map(str, values))), "\n").cast(f"array<{kind}>")


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "line"),
    ).where(
        "trim(line) <> ''",
    )


@dataclass(frozen=True)
class Template:
    """A text of a family (UNKNOWN: of a licence outside them). unit: the phrase or licence paragraph that it is a part of.

    kind: phrase, title, whole (a licence paragraph), or part of one.
    """

    family: int
    unit: str
    kind: str
    text: str


def templates() -> list[Template]:
    out = []
    for family, name in enumerate((*FAMILIES, None)):
        titles = license_texts.OTHER_TITLES if name is None else TITLES[name]
        texts = [t for ts in license_texts.OTHERS.values() for t in ts] if name is None else license_texts.FAMILIES.get(name, ())
        out += [Template(family, title, "title", title) for title in titles]
        out += [Template(family, phrase, "phrase", phrase.format(title)) for title in titles for phrase in PHRASES]
        out += [Template(family, text, "phrase", text) for text in NOTICES.get(name, ())]
        for text in texts:
            said = text.split()
            parts = {" ".join(said[i : i + WINDOW]) for i in range(0, max(1, len(said) - WINDOW // 2), WINDOW // 2)}
            parts |= {x for x in re.split(r"(?<=[.;])\s+", text) if len(x.split()) > 5}
            out.append(Template(family, text, "whole", text))
            out += [Template(family, text, "part", x) for x in sorted(parts) if x != text]
    return out


def _tokens(text: str) -> list[str]:
    """As words(), for the templates."""
    plain = re.sub(CUT, " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return plain.split()


def _training(spark: SparkSession) -> DataFrame:
    """(label, unit, tokens) of all templates, and variants of phrases that each lack a word. Of fixed size."""
    rows = set()
    for t in templates():
        own = _tokens(t.text)
        if not own:
            continue
        rows.add((t.family, t.unit, tuple(own)))
        if len(own) <= WINDOW and t.kind == "phrase":
            rows |= {(t.family, t.unit, tuple(own[:i] + own[i + 1 :])) for i in range(len(own)) if len(own) > 2}
    # wording that stands in several families says nothing of any
    by_words: dict[tuple, set[int]] = {}
    for family, _, own in rows:
        by_words.setdefault(own, set()).add(family)
    kept = sorted(r for r in rows if len(by_words[r[2]]) == 1)
    return spark.createDataFrame([(float(f), u, list(t)) for f, u, t in kept], "label double, unit string, tokens array<string>")


def wording() -> tuple[list[tuple[int, str, list[str]]], dict[str, float], float]:
    """(templates as family, kind and distinct words; the weight of each word; the weight of any other word)."""
    own = [(t, list(dict.fromkeys(_tokens(t.text)))) for t in templates()]
    texts = [set(ws) for t, ws in own if t.kind in ("whole", "title")]
    n = len(texts)
    weight = {w: math.log(1 + n / max(1, sum(w in x for x in texts))) for w in sorted({w for _, ws in own for w in ws})}
    notices = {text for texts in NOTICES.values() for text in texts}
    # a phrase fits by its title, a notice as one
    kinds = ((t.family, "title" if t.text in notices else t.kind, ws) for t, ws in own if ws and (t.kind != "phrase" or t.text in notices))
    return list({(f, k, tuple(ws)): (f, k, ws) for f, k, ws in kinds}.values()), weight, math.log(1 + n)


def confirmed(found: DataFrame, at_least: float) -> DataFrame:
    """found (doc_id, paragraph, tokens, top) with similarity and confirmed.

    similarity: the largest share of a template of the paragraph's family that the paragraph has, or of the paragraph that
    a licence text of the family has. It is confirmed if that is enough, and the family's best text or name fits better
    than that of any other: by share, then by the weight of the words in common, then by what the text has besides.
    """
    rows, weight, other = wording()
    at = {w: i for i, w in enumerate(weight)}
    sizes = [len(ws) for _, _, ws in rows]
    begin = [sum(sizes[:i]) + 1 for i in range(len(sizes))]
    words_of, begins, lengths = constant((at[w] for _, _, ws in rows for w in ws), "int"), constant(begin, "int"), constant(sizes, "int")
    families, kinds = constant((f for f, _, _ in rows), "int"), constant((k for _, k, _ in rows), "string")
    totals = constant((round(sum(weight[w] for w in ws), 9) for _, _, ws in rows), "double")
    distinct = F.array_distinct("tokens")
    met = F.zip_with(constant(weight, "string"), constant((round(x, 9) for x in weight.values()), "double"), lambda w, x: F.when(F.array_contains("distinct", w), x).otherwise(0.0))
    found = found.select("doc_id", "paragraph", "top", once(distinct, "distinct"))
    found = found.select("doc_id", "paragraph", "top", F.size("distinct").alias("n"), once(met, "met"))
    all_weight = F.aggregate("met", F.lit(0.0), lambda a, x: a + x) + (F.col("n") - F.size(F.filter("met", lambda x: x > 0))) * F.lit(other)
    found = found.select("*", once(all_weight, "all"))

    def fit(i: Column) -> Column:
        common = F.aggregate(F.slice(words_of, F.get(begins, i), F.get(lengths, i)), F.lit(0.0), lambda a, j: a + F.get("met", j))
        return F.struct(F.get(families, i).alias("family"), F.get(kinds, i).alias("kind"), F.get(totals, i).alias("total"), common.alias("common"))

    mine = lambda i: (F.get(families, i) == F.col("top.number")) | (F.get(kinds, i) != "part")
    found = found.select("*", once(F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(rows) - 1)), mine), fit), "fits"))

    def share(f: Column) -> Column:
        of_text = f["common"] / f["total"]
        of_paragraph = F.when(F.col("n") >= LEAST_WORDS, f["common"] / F.greatest("all", F.lit(1e-9))).otherwise(0.0)
        return F.round(F.when(f["kind"] == "whole", F.greatest(of_text, of_paragraph)).otherwise(of_text), 2)

    found = found.select("doc_id", "paragraph", "top", once(F.transform("fits", lambda f: F.struct(share(f).alias("share"), F.round(f["common"], 6).alias("weight"), F.round(f["common"] - f["total"], 6).alias("lacks"), f["family"].alias("family"), f["kind"].alias("kind"))), "fits"))
    best = lambda own: F.array_max(F.transform(F.filter("fits", lambda f: (f["kind"] != "part") & ((f["family"] == F.col("top.number")) == own)), lambda f: F.struct(f["share"], f["weight"], f["lacks"])))
    alike = F.array_max(F.transform(F.filter("fits", lambda f: f["family"] == F.col("top.number")), lambda f: f["share"]))
    found = found.select("doc_id", "paragraph", "top", F.coalesce(alike, F.lit(0.0)).alias("similarity"), best(F.lit(True)).alias("best"), best(F.lit(False)).alias("rival"))
    return found.withColumn("confirmed", (F.col("similarity") >= at_least) & F.coalesce(F.col("best") > F.col("rival"), F.lit(True)))


@dataclass
class Model:
    """weights: of each feature, for each family and unknown last; most are 0 and those features left out."""

    weights: dict[str, list[float]]
    bias: list[float]
    limit: float
    temperature: float = 1.0
    #: In how many of the sample's ordinary paragraphs each feature was, for those in any.
    common: dict[str, int] = field(default_factory=dict)

    def needed_words(self) -> list[str]:
        """Words of which a paragraph must have one to be of some family.

        Against unknown, a family's lead is at most its bias and all positive weights of the features there, and has to
        be that of the limit. Features that ordinary paragraphs have come first, then small weights; as soon as they could
        reach the limit, the features from there on are needed, and with a pair the rarer of its words.
        """
        out: set[str] = set()
        enough = self.temperature * math.log(self.limit / (1 - self.limit)) - 1e-4
        usual = lambda t: self.common.get(t, 0)
        for family in range(UNKNOWN):
            lead = [(w[family] - w[UNKNOWN], t) for t, w in self.weights.items() if w[family] > w[UNKNOWN]]
            reached = self.bias[family] - self.bias[UNKNOWN]
            for weight, term in sorted(lead, key=lambda x: (-usual(x[1]), x[0], x[1])):
                reached += weight
                if reached >= enough:
                    out.add(min(term.split("_"), key=lambda t: (usual(t), -len(t), t)))
        return sorted(out)


def _fit(data: DataFrame, rounds: int):
    return LogisticRegression(featuresCol="x", weightCol="weight", maxIter=rounds, regParam=0.0004, elasticNetParam=1.0, family="multinomial").fit(data)


def _calibrated(held: DataFrame) -> tuple[float, float]:
    """(temperature, limit) from held-out rows (label, raw): scores of each class."""
    softmax = lambda t, c: F.exp((c - F.array_max("raw")) / t) / F.aggregate("raw", F.lit(0.0), lambda a, s: a + F.exp((s - F.array_max("raw")) / t))
    true = F.get("raw", F.col("label").cast("int"))
    found = held.agg(*(F.avg(-F.log(F.greatest(F.lit(1e-12), softmax(t, true)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    if found is None or found[0] is None:
        return 1.0, 0.5
    temperature = min(zip(found, TEMPERATURES, strict=True))[1]
    best = F.array_max(F.slice("raw", 1, UNKNOWN))
    limit = held.where(F.col("label") == UNKNOWN).agg(F.percentile(softmax(temperature, best), MOST_FALSE)).first()[0]
    return temperature, min(MOST_LIMIT, max(0.5, limit or 0.5))


def train(docs: DataFrame, sample_docs: int = 500) -> Model:
    """sample_docs bounds the documents whose paragraphs stand for ordinary text: those with the smallest hash of their id."""
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    plain = paragraphs(docs.join(F.broadcast(ids), "doc_id")).select(F.lit(float(UNKNOWN)).alias("label"), F.col("line").alias("unit"), words(F.col("line")).alias("tokens"))
    # paragraphs that speak of licences are no examples of ordinary ones
    names = F.array(*map(F.lit, ("license", "licensed", "licence", "copyright", "spdx-license-identifier", "reserved")))
    plain = plain.where(~F.arrays_overlap("tokens", names)).withColumn("ordinary", F.lit(True))
    rows = _training(spark).withColumn("ordinary", F.lit(False)).unionByName(plain)
    rows = rows.select("label", "ordinary", "unit", F.array_join("tokens", " ").alias("key"), features(F.col("tokens")).alias("terms")).dropDuplicates(["label", "key"])
    held = F.pmod(F.xxhash64("unit"), F.when(F.col("ordinary"), 3).otherwise(5)) == 0
    rows = rows.withColumn("held", held).coalesce(2).persist()
    found = CountVectorizer(inputCol="terms", outputCol="x", binary=True, vocabSize=6000, minDF=2).fit(rows.where("not ordinary")).vocabulary
    count = {r["ordinary"]: r["count"] for r in rows.groupBy("ordinary").count().collect()}
    # words that ordinary paragraphs use are no features, nor pairs of such words: what is needed for a family then is rare
    asked = sorted({x for t in found for x in (t, *t.split("_"))})
    met = rows.where("ordinary").select(F.explode(F.array_intersect("terms", F.array(*map(F.lit, asked)))).alias("term")).groupBy("term").count()
    usual = {r["term"]: r["count"] for r in met.collect()}  # of the vocabulary alone
    most = MOST_USUAL * count.get(True, 0)
    vocabulary = [t for t in found if min(usual.get(w, 0) for w in t.split("_")) <= most]
    # ordinary text counts as much as all licences; wording outside the families twice
    weight = F.when(F.col("ordinary"), max(0.2, count.get(False, 1) / max(1, count.get(True, 1)))).when(F.col("label") == UNKNOWN, 2.0).otherwise(1.0)
    model = CountVectorizerModel.from_vocabulary(vocabulary, "terms", "x").setBinary(True)
    data = model.transform(rows).withColumn("weight", weight).persist()
    scores = _fit(data.where("not held"), 30).transform(data.where("held")).select("label", vector_to_array("rawPrediction").alias("raw"))
    temperature, limit = _calibrated(scores)
    fitted = _fit(data, 40)
    weights, bias = fitted.coefficientMatrix.toArray(), [float(b) for b in fitted.interceptVector]
    terms = {t: [float(v) for v in weights[:, i]] for i, t in enumerate(vocabulary) if abs(weights[:, i]).max() > 1e-6}
    data.unpersist()
    rows.unpersist()
    return Model(terms, bias, limit, temperature, usual)


def classify(docs: DataFrame, model: Model, confirmed_at: float = 0.75) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of each paragraph of docs that is of a known family."""
    found = paragraphs(docs).select("doc_id", "paragraph", once(words(F.col("line")), "tokens"))
    needed = model.needed_words()
    found = found.where(F.arrays_overlap("tokens", constant(needed, "string"))) if needed else found.where(F.lit(False))
    terms, n = sorted(model.weights), len(model.bias)
    names = constant(terms, "string") if terms else F.array().cast("array<string>")
    flat = constant((x for t in terms for x in model.weights[t]), "double")  # n for each term
    places = F.transform(F.array_intersect(features(F.col("tokens")), names), lambda t: F.array_position(names, t).cast("int"))
    found = found.select("*", once(places, "places"))
    score = F.aggregate("places", constant(model.bias, "double"), lambda a, p: F.transform(a, lambda x, i: x + F.get(flat, (p - 1) * n + i)))
    found = found.select("*", once(score, "score")).drop("places")
    best = F.array_max(F.slice("score", 1, UNKNOWN))
    chance = 1 / F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp((s - best) / F.lit(model.temperature)))
    top = F.struct((F.array_position("score", best) - 1).cast("int").alias("number"), F.round(chance, 6).alias("p"))
    found = found.select("doc_id", "paragraph", "tokens", once(top, "top")).where(F.col("top.p") >= model.limit)
    return confirmed(found, confirmed_at).select(
        "doc_id", "paragraph", F.get(F.array(*map(F.lit, FAMILIES)), F.col("top.number")).alias("family"),
        F.col("top.p").alias("probability"), "similarity", "confirmed",
    )


def save(model: Model, spark: SparkSession, path: str) -> None:
    """The model as one JSON text, so that later runs need not train."""
    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


def license_scan(docs: DataFrame, sample_docs: int = 500, model: Model | None = None) -> DataFrame:
    """classify() with the given model, or one that is trained here."""
    docs = docs.select("doc_id", "text")
    return classify(docs, model or train(docs, sample_docs))
