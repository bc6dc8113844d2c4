"""Small tables with the cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, start long"


def rows(n=60, seed=7, words=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(1, 9))) for _ in range(90)] + ["Éa", "ß.", "naïve,", "𝒳y", "12"]
    out = []
    for i in range(n):
        text = " ".join(r.choice(vocab) for _ in range(r.randint(1, words)))
        if i % 9 == 4:
            text = text.replace(" ", "\n", 2)
        out.append([i * 3, text, "en", "s", len(text), None, 5])
    out[3][1] = out[8][1]
    out[11][1] = out[8][1]
    return out


def hard(n=60, seed=7, words=40):
    """rows() with null and empty texts, a null id, a repeated id, repeated rows and a very long text."""
    out = rows(n, seed, words)
    out[5][1] = None
    out[6][1] = ""
    out[7][0] = None
    out[20][0] = out[21][0]
    out[30][1] = " ".join(x[1] or "" for x in out) * 6
    out[31][2] = out[31][3] = out[31][4] = None
    out[32][1] = "  lead\t\n tail   \U0001f468‍\U0001f469  é "
    out.append(list(out[12]))
    out.append(list(out[12]))
    return out


def table(spark, data):
    return spark.createDataFrame([tuple(x) for x in data], SCHEMA).repartition(3)
