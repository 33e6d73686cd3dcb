"""Items of every length are found inside long texts, word for word and changed."""

import numpy as np

from pitwall.llm import decontaminate


def test_items_of_every_length_in_long_texts(spark):
    rng = np.random.default_rng(3)
    rare = iter(range(10**6))
    filler = lambda n: " ".join(f"v{next(rare)}w" for _ in range(n))  # noqa: E731  words as rare as the items'
    items, docs, want = [], [], set()
    for n in [*range(1, 21), 33, 65]:
        w = [f"v{4000 + 100 * n + j}" for j in range(n)]
        items.append((n, " ".join(w)))
        docs.append((n, f"{filler(70)} {' '.join(w)} {filler(70)}"))
        want.add((n, n))
        if n >= 8:          # three words in ten are others
            other = w[:]
            for j in rng.choice(n, n - -(-7 * n // 10), replace=False):
                other[j] = f"new{n}w{j}"
            docs.append((100 + n, f"{filler(70)} {' '.join(other)} {filler(70)}"))
            want.add((100 + n, n))
    docs += [(200 + k, filler(100)) for k in range(30)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["id"], r["item_id"]) for r in found}
    assert want <= got
    assert not any(i >= 200 for i, _ in got)


def test_short_items_do_not_cross_texts(spark):
    docs = [(1, "a b"), (2, "c d"), (3, "x a b c d y"), (4, "a b c"), (5, "")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame([(1, "b c"), (2, "a b c d")], "item_id long, text string"))
    assert {(r["id"], r["item_id"], r["start"]) for r in found.collect()} == {(3, 1, 2), (3, 2, 1), (4, 1, 1)}


def test_latent_space_finds_planted_items(spark):
    """The latent path alone: a rank of half the items, words shared by all texts, verbatim and changed copies."""
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(400)]
    some = lambda n: rng.choice(common, n).tolist()
    items, docs, want = [], [], set()
    for k in range(64):
        w = [x if rng.random() < 0.4 else f"i{k}w{j}" for j, x in enumerate(some(int(rng.integers(12, 40))))]
        items.append((k, " ".join(w)))
        changed = w[:]
        for j in rng.choice(len(w), int(0.3 * len(w)), replace=False):
            changed[j] = str(rng.choice(common))
        for i, part in ((k, w), (100 + k, changed)):
            docs.append((i, " ".join(some(90) + part + some(90))))
            want.add((i, k))
    docs += [(1000 + k, " ".join(some(200))) for k in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(d, b, rank=32).collect()
    assert {(r["id"], r["item_id"]) for r in found} == want
    assert sum(r["latent"] for r in found) >= 0.9 * len(want)

    # with the thresholds of the fitted space, one of random directions finds next to nothing
    n_docs, passages, df = decontaminate.document_frequencies(d, "text")
    idf = np.log((n_docs + 1) / (df + 1)) + 0.01
    fitted, filler = decontaminate.latent_space(d, b, len(items), passages, idf, "text", rank=32)
    other = np.linalg.qr(rng.standard_normal(fitted.shape))[0].astype(np.float32)
    idf = np.append(idf, 0.0)
    recall = []
    for basis in (fitted, other):
        basis = np.vstack([basis, np.zeros_like(basis[:1])])
        it = decontaminate.Items(items, basis, idf, filler)
        limits = it.threshold if not recall else limits
        near = [decontaminate.cosines(decontaminate.planted(
            decontaminate.columns(np.array(w)), it.answers[k][1], 3 * int(it.scale[k]) // 2, filler, rng), basis, idf,
            it.latent[[k]]) >= limits[k] for k, w in enumerate(it.words)]
        recall.append(np.mean(near))
    assert recall[0] >= 0.9 and recall[1] < 0.5, recall


def test_benchmarks_of_several_blocks(spark, monkeypatch):
    items = [(k, " ".join(f"b{k}w{j}" for j in range(10))) for k in range(40)]
    docs = [(k, f"before it {t} after it") for k, t in items]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 7)
    assert {(r["id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()} == {(k, k) for k in range(40)}


def test_basis_comes_from_all_passages(spark):
    """the product with every passage of every text and item, by brute force; no sample."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, int(n))) for n in rng.integers(0, 400, 60)] + [None, "", "one"]
    df = spark.createDataFrame([(t, 1.0 + k % 3) for k, t in enumerate(texts)], "text string, weight double")
    idf = rng.uniform(0.5, 3, decontaminate.COLUMNS)
    basis = rng.standard_normal((decontaminate.COLUMNS, 5)).astype(np.float32)
    want = np.zeros((decontaminate.COLUMNS, 5))
    for k, t in enumerate(texts):
        c = decontaminate.columns(decontaminate.words(t or ""))
        for s in range(0, len(c), decontaminate.PASSAGE):
            part = c[s:s + decontaminate.PASSAGE]
            row = np.bincount(part, idf[part], decontaminate.COLUMNS) * (1.0 + k % 3) / np.sqrt((idf[part] ** 2).sum())
            want += np.outer(row, row @ basis)
    got = decontaminate.gram_times(df.repartition(3), basis, idf)
    assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()
    assert not hasattr(decontaminate, "sample_passages")


def test_sums_by_column_equal_those_one_by_one():
    rng = np.random.default_rng(8)
    y = rng.standard_normal((50, 3))
    cols = np.concatenate([rng.integers(0, decontaminate.COLUMNS, 300), np.full(200, 7), np.repeat([9, 11], [32, 33]),
                           [decontaminate.COLUMNS - 1]])
    rows = rng.integers(0, len(y), len(cols))
    got, want = np.ones((decontaminate.COLUMNS, 3)), np.ones((decontaminate.COLUMNS, 3))
    decontaminate.add_by_column(got, cols, rows, y)
    np.add.at(want, cols, y[rows])
    assert np.abs(got - want).max() < 1e-9
    decontaminate.add_by_column(got, cols[:0], rows[:0], y)


def test_paired_blocks_end_with_their_text():
    sums = np.arange(1.0, 8)[:, None]           # blocks of four texts: 3, 0, 1 and 2; then the zero row
    sums[-1] = 0
    wide, n = decontaminate.paired(sums, np.array([3, 0, 1, 2]))
    assert n.tolist() == [2, 0, 1, 1] and wide[:, 0].tolist() == [3.0, 3.0, 4.0, 11.0, 0.0]


def test_sums_shuffled_grow_with_the_cores_not_with_the_files(spark):
    """Pipeline on check_h: a sum of 10 MB from every small partition took more disk than allowed."""
    texts = spark.createDataFrame([(f"word{k} of part {k}", 1.0) for k in range(96)], "text string, weight double")
    basis = np.ones((decontaminate.COLUMNS, 2), np.float32)
    sc = spark.sparkContext
    sc.setJobGroup("sums", "sums of many small partitions")
    try:
        decontaminate.gram_times(texts.repartition(96), basis, np.ones(decontaminate.COLUMNS))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("sums")]
    stages = sorted({s for j in jobs for s in j.stageIds})
    tasks = [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)]
    assert sorted(tasks)[-1] <= max(sc.defaultParallelism, 8), tasks


def test_windows_of_repeated_words_are_not_judged(spark, monkeypatch):
    """A word of an item counts as often as the item has it: repeats of common words alone are no candidate."""
    item = "the cat of the house and the dog of the farm sleep"
    texts = {1: "the of and the " * 60, 2: f"{'x y z ' * 30}{item} {'u v w ' * 30}", 3: "the the the"}
    basis = np.ones((decontaminate.COLUMNS + 1, 2), np.float32)
    idf = np.append(np.ones(decontaminate.COLUMNS), 0.0)
    items = decontaminate.Items([(5, item)], basis, idf, np.arange(64))
    own = decontaminate.columns(np.array(items.words[0]))
    assert items.in_item[0].sum() == len(own) and items.in_item[0, items.nth[items.row[own[0]], 0]] == 4
    assert items.in_answer[0].sum() == items.answers[0][1]
    found = decontaminate.contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
                                       spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["id"], r["item_id"], r["lcs"]) for r in found] == [(2, 5, 1.0)]


def peak_of(work):
    """(result, most bytes allocated at once) of a call."""
    import tracemalloc
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_driver_widens_few_rows_at_once():
    """The pipeline passed the driver's memory: double copies of whole matrices."""
    a, b = np.random.default_rng(0).standard_normal((2, decontaminate.COLUMNS, 80), np.float32)
    got, most = peak_of(lambda: decontaminate.inner(a, b))
    assert np.allclose(got, a.T.astype(np.float64) @ b) and most < a.nbytes


def test_items_hold_their_own_columns_only():
    """The pipeline passed the driver's memory: a row of all columns per benchmark item, twice."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(12)) + ". " + " ".join(f"a{i}x{j}" for j in range(4))) for i in range(100)]
    basis = np.random.default_rng(0).standard_normal((decontaminate.COLUMNS + 1, 4)).astype(np.float32)
    idf = np.append(np.linspace(0.5, 5, decontaminate.COLUMNS), 0.0)
    items, most = peak_of(lambda: decontaminate.Items(rows, basis, idf, np.arange(1000)))
    assert most < 100 * 4 * decontaminate.COLUMNS
    for k in (0, 99):
        v = np.zeros(len(idf))
        np.add.at(v, at := decontaminate.columns(decontaminate.words(rows[k][1])), idf[at])
        want = v / np.linalg.norm(v) * idf
        assert np.allclose(items.product[items.row[:decontaminate.COLUMNS], k], want[:-1], rtol=1e-5)


def test_language_fit_widens_few_columns_at_once():
    """The pipeline passed the driver's memory: a double copy of all landmarks."""
    from pitwall.llm import language
    rng = np.random.default_rng(0)
    packed = [np.packbits(rng.random(language.WIDTH) < 0.01).tobytes() for _ in range(40)]
    (names, matrix, _), most = peak_of(lambda: language.fit(packed, ["a", "b"] * 20, 40, 1e-2))
    assert names == ["a", "b"] and matrix.shape == (language.WIDTH, 2) and most < 2.5 * 40 * 4 * language.WIDTH


def test_documents_are_read_twice(spark, tmp_path):
    """op1 over its CPU budget: each read of the texts hashed every word again, four times."""
    import uuid
    docs = spark.createDataFrame([(k, f"one two three four five six seven eight nine {k}") for k in range(40)],
                                 "doc_id long, text string")
    folder = str(tmp_path)

    def noted(batches):
        for b in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(b.num_rows))
            yield b

    b = spark.createDataFrame([(1, "three four five six seven eight nine 7")], "item_id long, text string")
    found = decontaminate.contaminated(docs.mapInArrow(noted, docs.schema), b).collect()
    assert (7, 1) in {(r["id"], r["item_id"]) for r in found}
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 2 * 40


def test_packed_columns_equal_the_words():
    import pyarrow as pa
    texts = ["a b c", "", "d", " ".join(f"w{k}" for k in range(300))]
    packed = [decontaminate.columns(decontaminate.words(t)).astype("<i2").tobytes() for t in texts]
    for kind in (pa.binary(), pa.large_binary()):
        cols, size = decontaminate.unpacked(pa.array(packed, kind).slice(1))
        assert size.tolist() == [0, 1, 300] and cols.tobytes() == b"".join(packed[1:])
        assert len(decontaminate.unpacked(pa.array([], kind))[0]) == 0
    assert decontaminate.cut_passages(np.array([0, 1, 64, 65, 0, 130])).tolist() == [1, 64, 64, 1, 64, 64, 2]


def test_second_path_weighs_a_repeated_word_once():
    """op1 over its CPU budget: a word of the item weighed as often as the item has it, for every time it was read."""
    rng = np.random.default_rng(2)
    text = "the cat of the house and the dog of the farm sleep under the old tree"
    idf = np.append(rng.uniform(0.5, 8, decontaminate.COLUMNS), 0.0)
    idf[decontaminate.columns(decontaminate.words("the of and"))] = 0.1, 0.12, 0.2
    basis = np.ones((decontaminate.COLUMNS + 1, 2), np.float32)
    items = decontaminate.Items([(5, text)], basis, idf, np.arange(64))
    weight = lambda w: int(items.steps[items.row[decontaminate.columns(np.array(w))]].sum())
    assert weight(decontaminate.words("the of and " * 8)) < items.limit[0] <= weight(items.words[0])
    hits = 0
    for _ in range(300):        # no window that is accepted weighs less
        kept = np.sort(rng.permutation(len(items.words[0]))[:rng.integers(6, 16)])
        window = np.array(items.words[0])[kept].tolist()
        if decontaminate.judge(items, 0, window)[0]:
            hits += 1
            assert weight(window) >= items.limit[0]
    assert hits > 20


def test_window_sums_stop_at_the_end_of_a_text():
    sums = np.array([[1], [2], [3], [4], [5], [6]], np.uint16)      # texts of one, two and three blocks
    got = decontaminate.window_sums(sums, np.array([1, 2, 1, 3, 2, 1]))
    assert got[[0, 1, 3], 0].tolist() == [1, 5, 15]
