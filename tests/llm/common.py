"""Small tables with the hard cases."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def sentence(r, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


def hard_documents(seed=0, n=60):
    """(doc_id, text, lang, source, n_chars): near and exact copies, shared passages, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    base = [sentence(r, r.choice([1, 3, 20, 60, 200])) for _ in range(n)]
    line = "the same line stands in very many of these texts"
    out = []
    for k, t in enumerate(base):
        if k % 4 == 0:
            t = t + "\n" + line
        out.append(t)
    for k in range(0, 30, 2):
        w = base[k].split(" ")
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // r.choice([8, 25, 60]))):
                v[r.randrange(len(v))] = f"x{r.randrange(99)}"
            out.append(" ".join(v))
    out += [base[1], base[1].upper() + " \t ", "", None, "  \n ", line, line, "É é ÀB 東京 x", "Straße", sentence(r, 9000, 50_000)]
    rows = [(k, t, ("en", "de", None, "xx")[k % 4], None if k % 9 == 0 else f"src{k % 5}", None if t is None else len(t)) for k, t in enumerate(out)]
    rows += [rows[0], (rows[2][0], "another text with the same id", "en", "src1", 29), (None, base[5], None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use inside.
CLASH = "digest string, node long, kept boolean, group_size long, row long, size long, words string, count long, key string"


def documents(spark, rows, clash=False, parts=3):
    if clash:
        rows = [(*r, "d", 1, True, 2, 3, 4, "w", 5, "k") for r in rows]
    return spark.createDataFrame(rows, SCHEMA + (", " + CLASH if clash else "")).repartition(parts)
