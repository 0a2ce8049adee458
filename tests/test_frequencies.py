from tidemark.operators import retrieval


def test_a_slot_sends_a_term_once_and_not_once_a_document(spark):
    texts = ["ab cd ab cd", "ab ef"]
    rows = [(i, texts[i % 2], None) for i in range(40)] + [(40, "ab", None), (40, "cd zz", None)]  # the last id has two rows
    placed = retrieval._placed(spark.createDataFrame(rows, "doc_id long, text string, scope string"), 3)
    split = placed.repartition(3, "slot").sortWithinPartitions("slot", "id").select("slot", "id", "scope", retrieval._words())
    found = retrieval.frequencies(split, retrieval.np.empty(0, "uint64"), 5, 3).collect()
    word = lambda w: retrieval.xxhash.xxh64_intdigest(w, 1)
    pair = lambda a, b: int(retrieval.pair_hashes(*(retrieval.np.array([word(w)], "uint64") for w in (a, b)))[0])
    told = {}
    for r in found:
        for term, df in zip(r.term, r.df):
            told.setdefault(term % 2**64, []).append((r.slot, df))
    assert all(len({s for s, _ in x}) == len(x) <= 3 and len({n for _, n in x}) == 1 for x in told.values())
    assert {w: told[word(w)][0][1] for w in ("ab", "cd", "ef")} == {"ab": 41, "cd": 21, "ef": 20} and word("zz") not in told
    assert told[pair("ab", "cd")][0][1] == 20 and pair("ab", "ef") in told and pair("cd", "zz") not in told
