import hashlib

from tidewell.llm import chat

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED), (1, 1, "assistant", "second"), (1, 0, "user", "first"), (1, 2, "user", "left open"), (2, 0, "user", "only a question"), (3, 0, "assistant", None), (3, 1, None, ""),
    (4, 0, "system", "\\<s>\\\\[OUT]<\\/s>[TXT"), (4, 1, "assistant", "[TXT]</s><s>[/INST]\\"), (5, None, "user", "no turn"), (5, 0, "assistant", "a"), (5, 0, "assistant", "a"), (5, 0, "assistant", "b"), (None, 0, "user[TXT]\n", "odd role"), (6, 0, "assistant", "é😀\n" * 100),
]


def test_digests_are_read_back(spark):
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(spark.createDataFrame(ROWS, SCHEMA))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in ROWS}:
        turns = sorted((r for r in ROWS if r[0] == c), key=key)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_one_example_for_each_reply(spark):
    out = chat.examples(spark.createDataFrame(ROWS[2:6], SCHEMA)).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["loss_chars"], r["is_last"]) for r in out] == [(1, 6, False), (1, 0, True), (2, 0, True)]
    assert out[0]["formatted"][out[0]["loss_start"] :][:6] == "second" and "left open" not in out[0]["formatted"]
    assert all(c not in chat.PLANTED.replace("</s>", "<\\/s>").replace("[INST]", "[\\INST]").replace("[/INST]", "[\\/INST]") for c in chat.CONTROLS)


def test_empty(spark):
    assert chat.digests(chat.examples(spark.createDataFrame([], SCHEMA))).count() == 0
