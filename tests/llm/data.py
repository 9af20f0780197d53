"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random
from pathlib import Path

LANGS = {"en": "the of and to in is that with for it was on".split(), "de": "der die und das ist nicht mit von auf für ein zu".split(), "fr": "le la et les des est une que pour dans qui sur".split()}
SLURS = "idiot moron scum trash pathetic".split()
#: Columns that operators make themselves, so that an input's own cannot disturb them.
CLASHING = ["score", "n", "key", "rank", "same", "kept", "held_out"]


def text(rng: random.Random, lang: str, n: int) -> str:
    syllables = {"en": "th er on an re", "de": "sch ein ung ver ch", "fr": "eau ou ai que ment"}[lang].split()
    words = [rng.choice(LANGS[lang]) if rng.random() < 0.5 else "".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def documents(n: int = 240, seed: int = 1) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        body = text(rng, lang, rng.randint(30, 80))
        quality, toxic = int(rng.random() > 0.3), int(rng.random() < 0.3)
        if toxic:
            words = body.split()
            for w in rng.sample(SLURS, 4):
                words.insert(rng.randrange(len(words)), w)
            body = " ".join(words)
        if not quality:
            body = " ".join(w.upper() + "!!" for w in body.split())
        rows.append({"doc_id": i, "text": body, "lang": lang, "source": rng.choice(["a", "a", "b", None]), "quality": quality, "toxic": toxic})
    base = rows[0]["text"]
    for copy in (base, base, base + " once more", base.upper()):
        rows.append(rows[0] | {"doc_id": len(rows), "text": copy})
    rows += [rows[5], rows[5]]  # repeated rows
    rows += [rows[1] | {"doc_id": 1000 + i, "text": t, "lang": None, "source": None} for i, t in enumerate((None, "", " \n\t", "12 34 $$", "word"))]
    rows.append(rows[1] | {"doc_id": 1010, "text": " ".join(text(rng, "en", 40) for _ in range(300))})
    rows.append(rows[2] | {"doc_id": None})
    return rows


def write(spark, folder: Path, rows: list[dict], pages: list[tuple] = (), items: list[tuple] = (), vectors: list[tuple] = ()) -> str:
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], *range(len(CLASHING))) for r in rows]
    kind = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASHING)
    spark.createDataFrame(docs, kind).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in rows] + ([(None, 1, 1), (3, None, None), (999_999, 0, 1)] if rows else [])
    for name, kind, table in (
        ("labels", "doc_id long, quality int, toxic int", labels), ("pages", "page_id long, url string, html string", pages),
        ("benchmark", "item_id long, text string", items), ("embeddings", "vec_id long, embedding array<float>, label int", vectors),
    ):
        clashing = [c for c in (*CLASHING, "bad", "host", "path", "place", "words", "segment", "list", "ids", "query_id") if f"{c} " not in kind]
        spark.createDataFrame([(*r, *range(len(clashing))) for r in table], f"{kind}, " + ", ".join(f"{c} int" for c in clashing)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def pages(n: int = 36, seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host = rng.choice(["a.example.com", "B.example.net", "www.c.example.org"])
        lines = [text(rng, "en", 12) for _ in range(3)]
        body = "".join(f"<p>{x}" for x in lines)
        out.append((i, f"http://{host}/{rng.choice(['en', 'de'])}/{i}?q#f", f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home {i}</a><li><a href=/x>More</a></ul></nav><div class='cookie-notice'>Accept {i}</div><article><h1>Head {i} &amp; co</h1>{body}<div>Share this page</div></article><div id=comments><p>First! {i}</p></div><footer>&copy; me {i}</footer></body></html>"))
    out += [(100, None, None), (101, "no scheme", ""), (102, "x://", "plain <b>text"), (103, "http://a.example.com/en/1", out[0][2]), (None, "http://a.example.com/", "<p>x"), out[3]]
    return out
