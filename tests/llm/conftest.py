import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = {"en": "the of and in to is was for that with as by on are this from".split(), "de": "der die das und nicht von mit auf für ist ein dem".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "ing" if lang == "en" else "ung", "ed" if lang == "en" else "keit"]) for _ in range(n))


def tables(seed=5, empty=False):
    """documents, pages, benchmark and labels with nulls in every column, copies, long texts, repeated rows and columns that clash."""
    rng = random.Random(seed)
    docs = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        docs.append((i, text(rng, lang, rng.choice([0, 1, 3, 20, 60, 150])), lang, f"src{i % 5}"))
    base = text(rng, "en", 120).split()
    for i in range(25):  # near copies
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = "swap"
        docs.append((200 + i, " ".join(w), "en", "src0"))
    passage = text(rng, "en", 50)
    docs += [(300 + i, f"{text(rng, 'en', 12)} {passage} {text(rng, 'en', 9)}", "en", "src1") for i in range(6)]
    docs += [(400 + i, "Same TEXT as ever. " * 9, "en", "src2") for i in range(7)]
    docs += [(420, "same text AS ever. " * 9, "en", "src2"), (421, text(rng, "de", 20_000), "de", "src3")]
    docs += [(430, None, "en", "src1"), (431, "", None, None), (432, " \t\n ", "de", "src4"), (433, "123 456", "en", "src4"), (None, text(rng, "en", 40), "en", "src4"), (None, None, None, None)]
    docs += [(440, "naïve café — ≠ ±1 don't, é 　 x", "en", "src4"), (441, "a\0b \0 <|endoftext|> <|", "en", "src4")]
    docs += [docs[5], docs[5], (6, "another text of a doc_id that is there", "en", "src1")]
    bench = [(i, text(rng, "en", n)) for i, n in enumerate([30, 40, 13, 5])] + [(7, passage), (7, passage), (None, text(rng, "en", 20)), (9, None), (10, "")]
    docs += [(500, f"{bench[0][1]} {text(rng, 'en', 30)}", "en", "src1"), (501, f"{text(rng, 'en', 400)} {bench[2][1]}", "en", "src1")]
    rng.shuffle(docs)
    pages = [(i, u) for i, u in enumerate(
        ["http://a.com", "http://a.com/x", "HTTPS://WWW.Example.COM/en/1?q#f", "http://blog.example.com/en/", "http://example.com/fr/en/", "http://notexample.com/en/", "x.net/es/", "http://x.net/es/1", "http://net/fr/", "http://fr.net/fr",
         "http://org/en/", None, "", "://", "://com/", "http://a.com?x=/en/", "http://example.com#/en/", "http://.example.com/en/", "http://example.com./en/", "http://é.com/ü/", "http://a.b.c.www.example.com/en/ /", "mailto:x", "http://com:80/", "http://EXAMPLE.com/EN/"]
    )] + [(None, "http://example.com/en/"), (3, "http://blog.example.com/en/")]
    labels = [(d[0], None if k % 17 == 0 else int(k % 5 != 0), 0) for k, d in enumerate(docs[:110])] + [(None, 1, 0), (99_999, 0, 1)]
    turns = [(c, t, ["user", "assistant"][t % 2], f"Turn {t} of {c}.") for c in range(9) for t in range(c)] + [(None, None, None, None)]
    vectors = [(i, [float(i % 5), 0.5, -0.25, i / 8], i % 3) for i in range(20)] + [(None, None, None)]
    if empty:
        docs, bench, pages, labels, turns, vectors = [], [], [], [], [], []
    clash = ["key", "n", "start", "node", "part", "count", "block", "size", "rank", "keep_id", "len", "head", "body", "label", "salt", "text_sha256"]
    n = len(docs)
    documents = pa.table({
        "doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string()), "lang": pa.array([d[2] for d in docs], pa.string()),
        "source": pa.array([d[3] for d in docs], pa.string()), "n_chars": pa.array([None if d[1] is None else len(d[1]) for d in docs], pa.int64()), **{c: pa.array([None] * n, pa.string()) for c in clash},
    })
    more = lambda k: {c: pa.array([None] * k, pa.string()) for c in ("key", "rule", "host", "path", "stack", "half", "text2")}
    return {
        "documents": documents,
        "benchmark": pa.table({"item_id": pa.array([b[0] for b in bench], pa.int64()), "text": pa.array([b[1] for b in bench], pa.string()), **more(len(bench))}),
        "pages": pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([None] * len(pages), pa.string()), **more(len(pages))}),
        "labels": pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32()), **more(len(labels))}),
        "conversations": pa.table({"conv_id": pa.array([x[0] for x in turns], pa.int64()), "turn": pa.array([x[1] for x in turns], pa.int64()), "role": pa.array([x[2] for x in turns], pa.string()), "text": pa.array([x[3] for x in turns], pa.string()), **more(len(turns))}),
        "embeddings": pa.table({"vec_id": pa.array([x[0] for x in vectors], pa.int64()), "embedding": pa.array([x[1] for x in vectors], pa.list_(pa.float32())), "label": pa.array([x[2] for x in vectors], pa.int32()), **more(len(vectors))}),
    }


def write(folder, made):
    for name, table in made.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    made = tables()
    return write(tmp_path_factory.mktemp("edge"), made), made


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), tables(empty=True))
