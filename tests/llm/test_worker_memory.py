"""What an encoding worker holds, and what it pays for."""

import gc

from metricgraph.llm import common, shards, tokens

PATH = common.vocabulary_path()


def test_a_worker_that_gives_out_ids_remembers_less(monkeypatch):
    whole = tokens.Encoder(PATH, most=100)
    texts = [" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[k]}" for i in range(60)) for k in range(6)]
    found = [ids for t in texts for ids, _ in whole([t])]
    assert len(whole.memory.known) <= 100
    assert found == [ids for ids, _ in tokens.Encoder(PATH)(texts)]
    assert tokens.WHOLE_CHUNKS < tokens.MAX_CHUNKS and tokens.WHOLE_ROWS < common.ROWS


def test_the_collector_rests_while_words_are_learnt():
    seen = []

    def work(v, chunks):
        seen.append(gc.isenabled())
        return shards.library_chunks(v, chunks)

    text = "Some words, don't; 42 <|endoftext|> ñandú"
    assert list(tokens.Encoder(PATH, work)([text])) == list(tokens.Encoder(PATH)([text]))
    assert seen == [False] and gc.isenabled()
