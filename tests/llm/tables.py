"""The small awkward table of these tests."""

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"word{i}" for i in range(40))


def awkward():
    texts = [
        "", None, " \n\t ", "one", "one two three", "one two three", PASSAGE, PASSAGE, PASSAGE.replace("word20", "changed"), "before " + PASSAGE + " after", "x " * 300, "Ünï cödé 😀 text with odd　blanks",
        "Released under the MIT License.\nMore text.", "A B C D E F G", "a b c d e f g", "tab\tand\x0bother\x1cblanks", "<|endoftext|> inside", "0" * 500, ("long text " + PASSAGE + "\n") * 30, PASSAGE + " " + PASSAGE,
    ]
    ids = list(range(len(texts)))
    texts += [PASSAGE, PASSAGE, "null id here " + PASSAGE, "another null id"]
    ids += [6, 6, None, None]  # repeated rows and null ids
    n = len(ids)
    lang, source = [None if i % 7 == 0 else "en" for i in range(n)], [None if i % 5 == 0 else f"src{i % 3}" for i in range(n)]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": lang, "source": source, "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "shard": ["mine"] * n, "fp": [1.5] * n, "node": ["x"] * n})


def rows_of(folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
