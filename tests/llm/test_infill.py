"""Fill-in-the-middle against a plain version that lists all units."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import infill

from .cases import by_id, documents, frame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    s = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(u), "plain", None, None, sha(text), sha(text)
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, x = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{x}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{x}<M>{m}"
    return doc_id, len(u), form, len(p), len(m), sha(out), sha(text)


def odd():
    r = random.Random(5)
    rows = documents() + [(9000 + i, t, "en", "a") for i, t in enumerate(["a <P> b", "<S>", "< P> <M", "x<", " lead", "tail \n", "\x1c\x1f w\x0b\x0cé", "   not space ", "z" * 200_000])]
    for i in range(60):
        n = r.choice([1, 2, 255, 256, 257, 511, 512, 513, 3000])
        rows.append((10_000 + i, "".join(r.choice(["é", "漢🙂", "abc", "q"]) + r.choice([" ", "\n\n", "\t "]) for _ in range(n)) + r.choice(["", "end", " "]), "fr", "b"))
    return rows


def test_infill_over_odd_texts(spark):
    rows = odd()
    got = by_id(infill.digests(frame(spark, rows).repartition(3)), *COLUMNS)
    assert got == sorted((plain(i, t) for i, t, _, _ in rows), key=repr)
    assert {"plain", "spm", "psm"} == {g[2] for g in got}
    assert infill.digests(frame(spark, [])).count() == 0


def test_outputs_give_the_texts_back(spark):
    rows = [(i, t, x, y) for i, t, x, y in odd() if i is not None]
    docs = frame(spark, rows).dropDuplicates(["doc_id"])
    out = infill.fill_in_middle(docs).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("was")), "doc_id")
    assert out.where(infill.restore(F.col("output"), F.col("form")) != F.col("was")).count() == 0
    assert out.where("form <> 'plain'").count() > 20


def test_checkpoints_lead_to_every_cut():
    """Whatever the distance of the checkpoints and the length of the pieces; few offsets are held."""
    r = random.Random(2)
    for every, piece in ((1, 1), (2, 7), (4, 64), (256, 3), (3, 1 << 16)):
        for end in ("", " ", "\r\n"):
            text = "".join(r.choice(["é", "漢", "ab", "🙂x"]) + " " * r.randint(1, 3) for _ in range(40)).strip() + end
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            index = infill.Checkpoints(data, every, piece)
            units = UNIT.findall(text)
            assert index.n == len(units) and len(index.bytes) == 1 + len(units) // every
            for k in range(len(units) + 1):
                said = "".join(units[:k])
                assert index.after(k) == (len(said.encode()), len(said))
    empty = infill.Checkpoints(np.zeros(0, dtype=np.uint8))
    assert empty.n == 0 and empty.after(0) == (0, 0)
