"""Choice of STEM_SHARE and STEM_ODDS by cross-validation inside the rows that labels may be learnt from.

python tests/llm/choose_stems.py [table folder]: mean log loss and AUC over four folds for each pair of values. Labels
of the held-out rows (crc32 of the id, modulo 5, is 0) are not read.
"""

import math
import sys
import tempfile
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[2]))
from rillwork.llm import toxicity as tx

SHARES, ODDS, FOLDS = (0.005, 0.01, 0.02, 0.04), (1.5, 2.5, 3.5), 4


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def main(sf):
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = tx.sample(docs, labels, "toxic", "doc_id", "text", tx.SAMPLE_PER_CLASS).toPandas()
    fold = rows.doc_id.map(lambda i: zlib.crc32(f"fold:{i}".encode()) % FOLDS).to_numpy()
    found = {}
    for k in range(FOLDS):
        known, asked = rows[fold != k], rows[fold == k]
        n = known.label.value_counts()
        counts = [tuple(r) for r in tx.stem_counts(spark.createDataFrame(known, "doc_id long, text string, label int"), 3).collect()]
        for share in SHARES:
            least = max(3, math.ceil(share * n[1]))
            for odds in ODDS:
                lexicon = tx.Lexicon(tx.chosen_stems([r for r in counts if r[1] >= least], n[1], n[0], odds))
                first = tx.Scorer(lexicon)
                x = np.column_stack([np.ones(len(known)), np.array([first.matches(t) for t in known.text])])
                w = tx.ridge_logistic(x, known.label.to_numpy(float), np.array([tx.PRIOR_INTERCEPT, *tx.PRIOR_WEIGHTS]))
                scorer = tx.Scorer(lexicon, float(w[0]), w[1:])
                p, y = np.array([scorer.score(t) for t in asked.text]), asked.label.to_numpy()
                q = np.clip(p, 1e-6, 1 - 1e-6)
                found.setdefault((share, odds), []).append((-np.mean(np.where(y == 1, np.log(q), np.log(1 - q))), auc(p, y), ((p >= 0.5) != y).mean(), len(lexicon.stems)))
    for key, values in found.items():
        print(*key, *np.round(np.mean(values, axis=0), 5))


if __name__ == "__main__":
    main(*(sys.argv[1:] or ["/root/testdata/sf0.1"]))
