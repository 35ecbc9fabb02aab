"""The whole pipeline against one document after another in plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lexweave.llm import pii, quality

from .test_decontam import expected
from .test_packing import check_places
from .test_pii import base_spans
from .test_simhash import fingerprint, smallest

SF = "/root/testdata/sf0.001"


def folder(spark, path):
    """The smallest tables with copies, near copies, benchmark passages, identifiers and odd rows among the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()]
    names = docs.columns
    rng, at = random.Random(6), names.index("text")

    def planted(text, source):
        row = list(source)
        row[names.index("doc_id")], row[at] = 10**6 + len(more), text
        more.append(tuple(row))

    more = []
    items = [r.text for r in benchmark.collect() if r.text]
    for source in rows[::9]:
        planted(source[at], source)
        planted(source[at] + " also", source)
        planted(source[at] + f" Mail me.{rng.randrange(99)}@example.org or 10.0.0.{rng.randrange(255)}, card 4111 1111 1111 1111.", rng.choice(rows))
        planted(rng.choice(items), source)
    for text in (None, "", " ", "word " * 30_000):
        planted(text, rows[0])
    spark.createDataFrame(rows + more, docs.schema).write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def redacted(text):
    """``text`` with base spans replaced; of spans that overlap the first one counts."""
    if text is None:
        return None
    out, at = "", 0
    for start, end, kind in sorted((s, e, k) for k, s, e in base_spans(text)):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_equals_one_document_after_another(spark, tmp_path):
    docs = folder(spark, str(tmp_path))
    field = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), field).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) == len(scores) == docs.count()
    good = sorted(i for i in texts if scores[i] >= quality.THRESHOLD)
    roots = smallest(good, [fingerprint(texts[i]) for i in good])
    single = sorted(set(roots))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    clean = [i for i in single if not expected(texts[i], items)[-1]]
    assert len(texts) > len(good) > len(single) > len(clean) > 0
    # On these texts the contexts add no spans to the base ones.
    found = pii.digest(pii.detect(docs.where(docs.doc_id.isin(clean)).select("doc_id", "text"))).collect()
    assert all((r.spans.split(",") if r.spans else []) == [":".join(map(str, s)) for s in base_spans(texts[r.doc_id])] for r in found)
    final = {i: redacted(texts[i]) for i in clean}
    assert any(final[i] != texts[i] for i in clean)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2] for i, text in final.items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert set(seen) == set(ids)
    for i, pieces in seen.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(ids[i]) and all(r.length == 1024 for r in pieces[1:])
    n = check_places(rows, (1024, 1024, 1024**2))
    assert n <= -(-sum(map(len, ids.values())) // 1024) + 3
