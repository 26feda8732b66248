import numpy as np

from spendspark.llm import media_copies as M


def test_query_finds_edited_copies_and_cases(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 0.2, (60, 64)).astype(np.float32).tolist()
    rows = [(i, vectors[i // 7]) for i in range(200)] + [(500, None), (501, []), (None, vectors[0]), (3, vectors[0]), (502, vectors[50])]
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, component_id int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = M.op6(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    found = {r.vec_id: r.component_id for r in got}
    # brute force: rows with one vector show one scene
    wrong = [i for i in range(200) if found[i] != i // 7 * 7]
    assert len(wrong) <= 4, wrong
    assert found[500] == 500 and found[501] == 501 and found[None] is None and found[502] == 502
    empty = spark.createDataFrame([], "media_id long, media binary")
    assert M.copies(empty).count() == 0


def test_images():
    assert M.read_image(None) is None and M.read_image(b"") is None and M.read_image(b"P5\n2 2\n255\nabc") is None and M.read_image(b"P6 x") is None
    flat = M.write_image(np.full((64, 64), 9))
    assert [len(M.describe(m)) for m in (flat, b"junk", None, M.write_image(np.zeros((3, 3))))] == [0] * 4
    assert not M.alike(M.describe(flat), M.describe(flat)) and M.keys_of(M.describe(flat)).shape == (0, M.TABLES)
    tall = M.write_image(np.random.default_rng(0).integers(0, 255, (40, 4000)))
    assert 0 < len(M.describe(tall)) <= sum(M.CORNERS) * (4000 // M.WINDOW + 1)
    assert np.array_equal(M.read_image(M.write_image(np.arange(12).reshape(3, 4))), np.arange(12).reshape(3, 4))


def scene_of(draw, side=96):
    cells = draw.integers(20, 220, (side // 4, side // 4)).astype(np.float32)
    return M._box(np.kron(cells, np.ones((4, 4), dtype=np.float32)), 1) / 9


def test_equals_brute_force_over_all_pairs(spark):
    draw, scenes = np.random.default_rng(12), []
    for i in range(12):
        scene = scene_of(draw)
        scenes += [scene, scene[5:81, 9:85], scene * 0.7 + 40, np.clip(scene + draw.normal(0, 5, scene.shape), 0, 255), np.rot90(scene, 1 + i % 3)]
    rows = [(100 + i, M.write_image(s)) for i, s in enumerate(scenes)]
    corners = [M.describe(m) for _, m in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if M.alike(corners[j], corners[i]):
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min(100 + i for i in range(60) if root[i] == r) for r in root}
    want = {100 + i: least[root[i]] for i in range(60)}
    assert all((v - 100) // 5 == (k - 100) // 5 for k, v in want.items()) and sum(want[k] == 100 + (k - 100) // 5 * 5 for k in want) == 60
    got = {r.media_id: r.component_id for r in M.copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert got == want


def test_meetings_carry_over_batches():
    import pyarrow as pa

    rows = [(1, 5, 5, 3), (1, 7, 7, 40), (1, 7, 8, 2), (1, 9, 9, 3), (2, 5, 6, 1), (3, 5, 5, 65), (3, 6, 6, 2)]
    want = [(5, 7, -1, 27), (5, 9, 0, 0), (5, 6, 2, 31)]
    for size in range(1, 8):
        batches = [pa.RecordBatch.from_pydict(dict(zip(("bucket", "component", "node", "pose"), map(list, zip(*rows[i : i + size]))))) for i in range(0, 7, size)]
        got = [tuple(r.values()) for b in M._meetings(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted((x, y, z * M.TURNS + (t + k) % M.TURNS) for x, y, z, t in want for k in (0, 1))


def test_noisy_copies_meet(spark):
    draw, rows = np.random.default_rng(7), []
    for i in range(100):
        scene = scene_of(draw)
        rows += [(2 * i, M.write_image(scene)), (2 * i + 1, M.write_image(np.clip(scene + draw.normal(0, 8, scene.shape), 0, 255)))]
    found = {r.media_id: r.component_id for r in M.copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert all(found[2 * i] == 2 * i and found[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(100))
    assert sum(found[2 * i + 1] == 2 * i for i in range(100)) >= 95


def test_parts_of_large_images_and_other_sizes(spark):
    draw, rows = np.random.default_rng(8), []
    for i in range(6):
        scene = scene_of(draw, 768)
        rows += [(3 * i, M.write_image(scene)), (3 * i + 1, M.write_image(scene[301:421, 402:522])), (3 * i + 2, M.write_image(M._smaller(scene)))]
    assert len(M.describe(rows[0][1])) > 10 * len(M.describe(rows[1][1]))
    found = {r.media_id: r.component_id for r in M.copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert [found[k] for k in range(18)] == [k // 3 * 3 for k in range(18)]


def test_drawn_scenes_are_shared_and_edited(spark):
    # 60 scenes by the signs of vectors that are all different, in each edit
    draw = np.random.default_rng(9)
    signs = [[1.0 if n >> k & 1 else -1.0 for k in range(M.SIGNS)] for n in draw.choice(2**M.SIGNS, 60, replace=False)]
    rows = [(i, (np.array(signs[i % 60]) * draw.uniform(0.1, 1, M.SIGNS)).tolist()) for i in range(400)]
    assert len({tuple(v) for _, v in rows}) == 400
    found = {r.media_id: r.component_id for r in M.copies(M.media_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()}
    wrong = [i for i in range(400) if found[i] != i % 60]
    assert all(found[i] % 60 == i % 60 for i in range(400))
    assert len(wrong) <= 12, wrong


def test_foreign_images_at_the_head_of_all_buckets_hide_no_link(spark, monkeypatch):
    # Two shifted copies of each scene; smaller ids have the same corners (so all keys), but strewn anew, and are copies of none.
    draw, rows = np.random.default_rng(21), []
    for k in range(6):
        first = M.describe(M.write_image(scene_of(draw)))
        second = first.copy()
        second["y"], second["x"] = first["y"] + 3, first["x"] - 5
        heads = [first.copy() for _ in range(3)]
        for head in heads:
            head["y"], head["x"] = draw.uniform(0, 96, len(first)), draw.uniform(0, 96, len(first))
        assert M.alike(first, second) and not any(M.alike(h, c) for h in heads for c in (first, second, *heads) if c is not h)
        rows += [(10 * k + i, c) for i, c in enumerate(heads)] + [(100 + 2 * k, first), (101 + 2 * k, second)]
    table = [(i, str(i).encode(), len(c), c.tobytes()) for i, c in rows]
    given = spark.createDataFrame(table, "media_id long, image_key binary, n_corners long, corners binary")
    monkeypatch.setattr(M, "described", lambda df: given)
    got = {r.media_id: r.component_id for r in M.copies(spark.createDataFrame([], "media_id long, media binary")).collect()}
    assert got == {i: i if i < 100 else i // 2 * 2 for i, _ in rows}


def test_last_pass_meets_all_pairs_that_share_keys(monkeypatch):
    draw = np.random.default_rng(22)
    bits = draw.integers(0, 256, (15, M.TESTS // 8), dtype=np.uint8)
    images = []
    for i in range(40):
        own = np.zeros(draw.integers(0, 9), dtype=M.CORNER)
        own["bits"], own["turn"], own["level"] = bits[draw.integers(0, 15, len(own))], draw.choice([0, 1, 2, 9, M.TURNS - 1], len(own)), draw.integers(0, 2, len(own))
        images.append(own)
    component = draw.integers(0, 12, 40)

    def shared(a, b):
        cells = {}
        for key, one in zip(M.keys_of(a).ravel(), np.repeat(np.arange(len(a)), M.TABLES)):
            for other in np.repeat(np.arange(len(b)), M.TABLES)[M.keys_of(b).ravel() == key]:
                zoom, turn = int(a["level"][one]) - int(b["level"][other]), (int(a["turn"][one]) - int(b["turn"][other])) % M.TURNS
                for cell in ((zoom, turn), (zoom, (turn + 1) % M.TURNS)):
                    cells[cell] = cells.get(cell, 0) + 1
        return max(cells.values(), default=0) >= M.MEET

    monkeypatch.setattr(M, "keys_of", lambda c, of=M.keys_of: of(c)[:, :1])
    monkeypatch.setattr(M, "TABLES", 1)
    want = {(i, j) for i in range(40) for j in range(i) if component[i] != component[j] and shared(images[j], images[i])}
    assert 50 < len(want) < 600

    def block(part):
        import pyarrow as pa

        return M._block(pa.table({"node": pa.array(part, pa.int64()), "component": component[part], "corners": [images[i].tobytes() for i in part]}))

    whole, even, odd = (np.arange(40)[s] for s in (slice(None), slice(0, None, 2), slice(1, None, 2)))
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(M, "PAIRS", most)
        for blocks in ([(whole, whole)], [(even, even), (odd, odd), (even, odd)]):
            met = [(a[i], b[j]) for a, b in blocks for x, y in M._met(block(a)[3:], block(b)[3:], component[a], component[b], a is b) for i, j in zip(x, y)]
            assert len(met) == len(want) and {(max(p), min(p)) for p in met} == want


def test_last_pass_stores_each_image_once_however_many_blocks_meet(spark, monkeypatch):
    draw, rows = np.random.default_rng(23), []
    for i in range(14):
        first = M.describe(M.write_image(scene_of(draw)))
        second = first.copy()
        second["y"], second["x"] = first["y"] + 3, first["x"] - 5
        rows += [(2 * i, 2 * i, first.tobytes()), (2 * i + 1, 2 * i + 1, second.tobytes())]
    stored, write = [], M.written
    monkeypatch.setattr(M, "written", lambda df, what, **options: stored.append(write(df, what, **options)) or stored[-1])
    heads = spark.createDataFrame([rows[i] for i in draw.permutation(28)], "node long, component long, corners binary")
    for blocks in (1, 7):
        monkeypatch.setattr(M, "BLOCKS", blocks)
        links = M.remaining(heads, 28)
        assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
        found = stored.pop().select("node").collect()
        assert not stored and len(found) >= blocks and sorted(n for r in found for n in r.node) == list(range(28))
        assert {(r.x, r.y) for r in links.collect()} == {(2 * i, 2 * i + 1) for i in range(14)}


def test_matches_of_many_pairs_equal_those_of_each(monkeypatch):
    draw = np.random.default_rng(24)
    images = []
    for size in (0, 1, 5, 300, 40, 7):
        own = np.zeros(size, dtype=M.CORNER)
        own["bits"] = np.packbits(draw.random((size, M.TESTS)) < draw.choice([0.05, 0.95], (size, 1)), axis=1)
        images.append(own)
    # all bits differ: a count that doesn't fit a byte
    images[1]["bits"], images[2]["bits"][0] = 0, 255
    corners, ends = np.concatenate(images), np.cumsum([len(o) for o in images])
    bits = np.ascontiguousarray(np.ascontiguousarray(corners["bits"]).view("<u8").T)
    x, y = (v.ravel() for v in np.meshgrid(range(6), range(6), indexing="ij"))
    for looks in (1, 1000, 1 << 16):
        monkeypatch.setattr(M, "LOOKS", looks)
        of, p, q = M._all_matches(bits, ends, x, y)
        got = {(a, b): set() for a in range(6) for b in range(6)}
        for k, i, j in zip(of, p, q):
            got[x[k], y[k]].add((i - (ends[x[k]] - len(images[x[k]])), j - (ends[y[k]] - len(images[y[k]]))))
        assert len(of) == sum(map(len, got.values())) > 1000
        assert all(got[a, b] == set(zip(*M.matches(images[a], images[b]))) for a, b in got)


def test_bits_are_counted_where_shadows_are_near_and_no_match_is_left_out(monkeypatch):
    draw = np.random.default_rng(25)
    real = np.concatenate([M.describe(M.write_image(scene_of(draw))) for _ in range(12)])
    strange = np.zeros(200, dtype=M.CORNER)
    strange["bits"] = np.packbits(draw.random((200, M.TESTS)) < draw.choice([0.0, 0.1, 0.5, 1.0], (200, 1)), axis=1)
    own = np.concatenate([real, strange, real])
    # copies with just as many flipped bits as a match may have, and with one more
    flipped = np.unpackbits(own["bits"][-len(real) :], axis=1)
    for k, row in enumerate(flipped):
        row[draw.choice(M.TESTS, M.FLIPS + k % 2, replace=False)] ^= 1
    own["bits"][-len(real) :] = np.packbits(flipped, axis=1)
    bits = np.unpackbits(own["bits"], axis=1).astype(np.int64)
    flips = (bits[:, None] != bits).sum(axis=2)
    points = M._shadows(own)[:, : M.AXES].astype(np.float64)
    apart = ((points[:, None] - points) ** 2).sum(axis=2)
    assert (apart <= flips + 0.01).all() and (flips <= M.FLIPS).sum() > len(own)
    n = len(real)
    assert (apart[:n, :n] <= M.FLIPS + 0.2).mean() < 0.15
    half, words = len(own) // 2, np.ascontiguousarray(np.ascontiguousarray(own["bits"]).view("<u8").T)
    want = set(zip(*np.nonzero(flips[:half, half:] <= M.FLIPS)))
    shadows = M._shadows(own)
    for given in (None, (shadows, shadows), (shadows[:half], shadows[half:])):
        of, p, q = M._all_matches(words, np.array([half, len(own)]), np.array([0]), np.array([1]), given)
        assert len(p) == len(want) and set(zip(p, q - half)) == want


def test_a_block_is_made_ready_once_for_the_blocks_that_it_meets_next(monkeypatch):
    import pyarrow as pa

    draw, made, block = np.random.default_rng(26), [], M._block
    monkeypatch.setattr(M, "_block", lambda images: made.append(images["node"][0].as_py()) or block(images))
    first = [M.describe(M.write_image(scene_of(draw))) for _ in range(4)]
    columns = {}
    for b in range(4):
        moved = [c.copy() for c in first]
        for c in moved:
            c["y"], c["x"] = c["y"] + 2 * b, c["x"] - 3 * b
        columns[b] = {"block": b, "node": [10 * b + i for i in range(4)], "component": [10 * b + i for i in range(4)], "corners": [c.tobytes() for c in moved]}
    rows = [{f"{c}_{side}": v for side, number in zip("ab", pair) for c, v in columns[number].items()} for pair in ((0, 0), (0, 1), (0, 2), (0, 3))]
    links = [link for b in M._linked_blocks(iter([pa.RecordBatch.from_pylist(rows[:2]), pa.RecordBatch.from_pylist(rows[2:])])) for link in zip(*b.to_pydict().values())]
    assert sorted(links) == [(i, 10 * b + i) for i in range(4) for b in (1, 2, 3)]
    assert made == [0, 10, 20, 30]
