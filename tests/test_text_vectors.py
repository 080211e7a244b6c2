"""The caller's encoder, projections, and languages by function words."""

import numpy as np
from pyspark.sql import functions as F

from rowaudit.functions.text import likely_language
from rowaudit.operators import rules as ru
from rowaudit.operators.text import embed_text


def test_encoder_and_projection(spark):
    def toy_encoder():
        """Loads a 'model': counts of the letters a to e."""
        return lambda texts: np.array([[t.count(c) for c in "abcde"] for t in texts], float)

    rows = [(i, "a" * (i % 7) + "b" * (i % 3) + "c") for i in range(200)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(4)
    got = {r.row_id: r.embedding for r in embed_text(df, "text", encoder=toy_encoder, batch=7).collect()}
    assert len(got) == 202 and got[5] == [5.0, 2.0, 1.0, 0.0, 0.0] and got[200] == got[201] == [0.0] * 5
    flat = np.array([x for x in embed_text(df, "text", encoder=toy_encoder, components=2).toPandas().embedding.tolist()])
    assert flat.shape == (202, 2) and flat[:, 0].var() >= flat[:, 1].var() > 0
    assert abs(np.cov(flat.T)[0, 1]) < 1e-9
    plain = embed_text(df, "text", dim=32, components=3).first().embedding
    assert len(plain) == 3


def test_language_without_a_column(spark):
    texts = {"en": "the cat and the dog of this house", "de": "der Hund und die Katze ist nicht das Haus", "fr": "le chat est dans la maison avec les chiens",
             "es": "el perro no es para los gatos del campo", None: "xyz 123"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts.values(), None])], "row_id long, text string")
    got = [r.l for r in df.select("row_id", likely_language("text").alias("l")).orderBy("row_id").collect()]
    assert got == [*texts, None]
    rules = ru.TextRules(min_length=0, flag_urls=False, flag_gibberish=False, language="de")
    flagged = ru.check_text(df, "text", rules, name="p").where(F.col("p.reason") == "Language mismatch").select("row_id").collect()
    assert sorted(r[0] for r in flagged) == [0, 2, 3, 4, 5]
