"""Copies of images, cropped or edited, by local descriptors.

Corners are found at several scales; around each, a patch turned to its own orientation gives 256 binary tests. All
descriptors are compared by Hamming distance, groups of images against groups, and matches that agree on one placement
make a link. That is quadratic: at 16 of 256 bits one pair of corners of unlike images in 10,000 matches, so no table of
pieces tells the pairs apart that can link. Where a caller may miss weak links, images meet in hash tables on 128-bit
pieces of the descriptors, and only pairs that met are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_if_small, handing_back, slices, written
from .components import connected_components

SCALES, TESTS, RADIUS = (1.0, 1.5, 2.0), 256, 7
#: Corners of a scale: one for so many pixels, and so many at least.
PIXELS_A_CORNER, MIN_CORNERS = 256, 8
#: A test counts as set where the difference is at least this share of the patch's deviation: flat areas give zeros.
MARGIN = 0.12
#: Bits by which matching descriptors differ at most; matches on one placement that make a link; pixels by which their
#: placements differ at most, at the larger scale of the two.
MAX_BITS, MIN_VOTES, TOLERANCE = 16, 3, 3.0
#: Bits of a piece, and tables: from 64 bits a piece would be common among unlike images.
PIECE, TABLES = 128, TESTS // 128
#: Pieces that two contents must share to be compared: copies share far more.
MIN_SHARED = 2
#: Contents with a piece from which on it is common: those meet by two pieces and their layout.
COMMON = 64
#: Contents, and bytes of descriptors, of a group for the comparison of all; pairs of groups that a task is handed at once.
GROUP_CONTENTS, GROUP_BYTES, PAIRS_AT_ONCE = 500, 2 << 20, 4
#: Descriptors compared at once, of the group that is held and of the one that is read.
TILE_HELD, TILE_READ = 8192, 32
#: Pixels worked on at once.
PIXELS_AT_ONCE = 1 << 19
DESCRIPTOR = np.dtype([("x", "<i4"), ("y", "<i4"), ("angle", "u1"), ("scale", "u1"), ("bits", "u1", TESTS // 8)])

_rng = np.random.default_rng(2024)
_radius, _turn = RADIUS * np.sqrt(_rng.uniform(0.02, 0.85, (TESTS, 2))), _rng.uniform(0, 2 * np.pi, (TESTS, 2))
#: For each angle in sixteenths, the places (y, x) of the two points of every test.
_POINTS = np.stack([np.stack((np.rint(_radius * np.sin(_turn + a * np.pi / 8)), np.rint(_radius * np.cos(_turn + a * np.pi / 8))), -1) for a in range(16)]).astype(np.int64)
_R = np.arange(-RADIUS, RADIUS + 1)
_DISC = (_R[:, None] ** 2 + _R**2 <= RADIUS**2).astype(np.float32)


def _blur(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="edge")
    p = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return (p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]) / 16


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    a = _blur(a)
    for axis in (1, 2):
        at = (np.arange(int(a.shape[axis] / scale)) + 0.5) * scale - 0.5
        low = np.clip(at.astype(np.int64), 0, max(0, a.shape[axis] - 2))
        part = (at - low).astype(np.float32).reshape((-1, 1) if axis == 1 else (-1,))
        a = np.take(a, low, axis) * (1 - part) + np.take(a, np.minimum(low + 1, a.shape[axis] - 1), axis) * part
    return a


def describe(images: np.ndarray) -> list[np.ndarray]:
    """The descriptors of each of a stack of grey images of one size; none in a flat image."""
    found: list[list[np.ndarray]] = [[] for _ in images]
    for step, scale in enumerate(SCALES):
        a = _blur(_blur(_resized(images.astype(np.float32), scale)))
        edge = RADIUS + 2
        if min(a.shape[1:]) <= 2 * edge + 2:
            continue
        gx, gy = np.zeros_like(a), np.zeros_like(a)
        gx[:, :, 1:-1], gy[:, 1:-1] = a[:, :, 2:] - a[:, :, :-2], a[:, 2:] - a[:, :-2]
        xx, yy, xy = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        near = [strength[:, edge + i : strength.shape[1] - edge + i, edge + j : strength.shape[2] - edge + j] for i in (-1, 0, 1) for j in (-1, 0, 1)]
        inner = near[4]
        peak = inner > 1
        for other in near:
            peak &= inner >= other
        flat = np.where(peak, inner, 0).reshape(len(a), -1)
        most = min(flat.shape[1], max(MIN_CORNERS, a.shape[1] * a.shape[2] // PIXELS_A_CORNER))
        best = np.argpartition(-flat, most - 1, 1)[:, :most]
        image, column = np.nonzero(np.take_along_axis(flat, best, 1) > 0)
        y, x = np.divmod(best[image, column], inner.shape[2])
        y, x = y + edge, x + edge
        if not len(image):
            continue
        patch = a[image[:, None, None], y[:, None, None] + _R[:, None], x[:, None, None] + _R] * _DISC
        mean = patch.sum((1, 2)) / _DISC.sum()
        mass = (patch - mean[:, None, None]) * _DISC
        deviation = np.sqrt((mass**2).sum((1, 2)) / _DISC.sum())
        angle = np.rint(np.arctan2((mass * _R[:, None]).sum((1, 2)), (mass * _R).sum((1, 2))) / (2 * np.pi) * 16).astype(np.int64) % 16
        width = a.shape[2]
        at = ((image * a.shape[1] + y) * width + x)[:, None]
        values, points = a.reshape(-1), _POINTS[angle]
        bits = values[at + points[:, :, 0, 0] * width + points[:, :, 0, 1]] + MARGIN * deviation[:, None] < values[at + points[:, :, 1, 0] * width + points[:, :, 1, 1]]
        rows = np.empty(len(image), DESCRIPTOR)
        rows["x"], rows["y"], rows["angle"], rows["scale"], rows["bits"] = np.rint((x + 0.5) * scale - 0.5), np.rint((y + 0.5) * scale - 0.5), angle, step, np.packbits(bits, 1)
        cuts = np.searchsorted(image, np.arange(len(a) + 1))
        for i in range(len(a)):
            found[i].append(rows[cuts[i] : cuts[i + 1]])
    return [np.concatenate(x) if x else np.empty(0, DESCRIPTOR) for x in found]


def placements(a: np.ndarray, b: np.ndarray) -> int:
    """How many corners of a match corners of b on the one placement that most agree on."""
    if not len(a) or not len(b):
        return 0
    apart = np.bitwise_count(a["bits"].view("<u8")[:, None] ^ b["bits"].view("<u8")[None]).sum(2)
    i, j = np.nonzero(apart <= MAX_BITS)
    if len(i) < MIN_VOTES:
        return 0
    scales = np.array(SCALES)
    turn = (a["angle"][i].astype(int) - b["angle"][j]) % 16
    sa, sb = scales[a["scale"][i]], scales[b["scale"][j]]
    ratio, size = sa / sb, np.maximum(sa, sb)
    best = 0
    for t, r in sorted(set(zip(turn.tolist(), ratio.tolist(), strict=True))):
        # Turns next to each other agree: the placement is worked out with the turn of the hypothesis.
        on = (np.abs((turn - t + 8) % 16 - 8) <= 1) & (np.abs(ratio / r - 1) < 0.1)
        if on.sum() <= best or on.sum() < MIN_VOTES:
            continue
        c, s = np.cos(t * np.pi / 8), np.sin(t * np.pi / 8)
        x, y = b["x"][j[on]], b["y"][j[on]]
        dx = a["x"][i[on]] - r * (c * x - s * y)
        dy = a["y"][i[on]] - r * (s * x + c * y)
        near = np.maximum(np.abs(dx[:, None] - dx), np.abs(dy[:, None] - dy)) <= TOLERANCE * size[on][:, None]
        for k in range(len(near)):
            if near[k].sum() > best:
                best = max(best, min(len(set(i[on][near[k]].tolist())), len(set(j[on][near[k]].tolist()))))
    return best


def _pieces(d: np.ndarray) -> np.ndarray:
    """A key for each descriptor and table: a hash of PIECE bits and of the table's number."""
    words = d["bits"].view("<u8").reshape(len(d), TABLES, PIECE // 64)
    mixed = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), (len(d), TABLES)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(PIECE // 64):
        mixed = (mixed ^ words[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _contents(found: DataFrame) -> DataFrame:
    return found.where("d IS NOT NULL").select("content", "d")


def _candidates(contents: DataFrame) -> DataFrame:
    """Every pair (a, b), a > b, of contents that share MIN_SHARED pieces: two that at most COMMON contents have, or one
    of them where both have common pieces too, or two common pieces in one layout, as common ones alone would meet in
    too many pairs."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.unique(_pieces(np.frombuffer(d.as_buffer(), DESCRIPTOR))) for d in b.column(1)]
            content = np.repeat(b.column(0).to_numpy(), [len(x) for x in each])
            keys = np.concatenate([*each, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(content)], ["piece", "content"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From postings sorted by piece and content: pairs, or the piece itself where it is common."""
        last, held, told = None, [], False
        for b in batches:
            piece, content = b.column(0).to_numpy(), b.column(1).to_numpy()
            # Most pieces are met once: only rows beside one of the same piece are looked at.
            same = np.zeros(len(piece), bool)
            same[1:] = piece[1:] == piece[:-1]
            same[:-1] |= same[1:]
            if len(piece):
                same[0] |= True
                same[-1] |= True
            pairs, common = [], []
            for p, c in zip(piece[same].tolist(), content[same].tolist(), strict=True):
                if p != last:
                    last, held, told = p, [], False
                if held and held[-1] == c or told:
                    continue
                if len(held) >= COMMON:
                    told = True
                    common.append(p)
                    continue
                held.append(c)
                pairs.extend((c, x) for x in held[:-1])
            if pairs:
                a, n = np.unique(np.array(pairs), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.nulls(len(a), pa.int64()), pa.array(n.astype(np.int64))], ["a", "b", "common", "n"])
            if common:
                n = len(common)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(common, pa.int64()), pa.nulls(n, pa.int64())], ["a", "b", "common", "n"])

    posted = contents.mapInArrow(post, "piece long, content long").repartition("piece").sortWithinPartitions("piece", "content")
    met = written(posted.mapInArrow(meet, "a long, b long, common long, n long"), "met")
    pairs = written(met.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs-met")
    enough = pairs.where(F.col("n") >= MIN_SHARED).select("a", "b")
    common = met.where("common IS NOT NULL").select(F.col("common").alias("piece")).distinct()
    if common.isEmpty():
        return enough
    hot, layouts = _layouts(contents, common)
    few = pairs.where(F.col("n") < MIN_SHARED)
    for end in ("a", "b"):
        few = few.join(broadcast_if_small(hot.withColumnRenamed("content", end)), end, "left_semi")
    return enough.unionByName(few.select("a", "b")).unionByName(layouts)


def _layouts(contents: DataFrame, common: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contents with common pieces, and pairs of them that share two such pieces in one layout."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(d.as_buffer(), DESCRIPTOR) for d in b.column(1)]
            content, d = np.repeat(b.column(0).to_numpy(), [TABLES * len(x) for x in each]), np.concatenate([*each, np.empty(0, DESCRIPTOR)])
            cols = [np.repeat(d[n], TABLES).astype(np.int32) for n in ("x", "y", "angle", "scale")]
            yield pa.RecordBatch.from_arrays([pa.array(content), pa.array(_pieces(d).reshape(-1).view(np.int64)), *map(pa.array, cols)], ["content", "piece", "x", "y", "angle", "scale"])

    rows = contents.mapInArrow(spread, "content long, piece long, x int, y int, angle int, scale int")
    hot = written(rows.join(broadcast_if_small(written(common, "common-pieces")), "piece", "left_semi").distinct(), "common")
    two = hot.select("content", *[F.col(c).alias(f"{c}_1") for c in hot.columns if c != "content"]).join(hot, "content").where("piece_1 <= piece")
    angle, size = F.col("angle_1") * (3.141592653589793 / 8), F.element_at(F.array(*map(F.lit, SCALES)), F.col("scale_1") + 1)
    dx, dy = F.col("x") - F.col("x_1"), F.col("y") - F.col("y_1")
    # Votes of one placement lie at most twice the tolerance apart, so the cells of two layouts are neighbours.
    u, v = (F.floor(e / size / (2 * TOLERANCE)).cast("int") for e in (F.cos(angle) * dx + F.sin(angle) * dy, F.cos(angle) * dy - F.sin(angle) * dx))
    layout = ["piece_1", "piece", "u", "v"]
    two = two.where((dx != 0) | (dy != 0)).select("content", "piece_1", "piece", u.alias("u"), v.alias("v")).distinct()
    near = lambda c: F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])).alias(c)
    probes = two.select(F.col("content").alias("a"), "piece_1", "piece", near("u"), "v").select("a", "piece_1", "piece", "u", near("v"))
    pairs = probes.join(two.select(F.col("content").alias("b"), *layout), layout).where("a > b").select("a", "b").distinct()
    return written(hot.select("content").distinct(), "hot-contents"), pairs


def _matches(held: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two arrays of descriptors, as rows of four 64-bit words, of all pairs that differ by MAX_BITS at most."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    words = np.ascontiguousarray(held.T)
    for lo in range(0, len(held), TILE_HELD):
        a = words[:, lo : lo + TILE_HELD]
        for at in range(0, len(read), TILE_READ):
            b = read[at : at + TILE_READ]
            # half of the bits rules out most pairs
            apart = np.bitwise_count(b[:, :1] ^ a[0]) + np.bitwise_count(b[:, 1:2] ^ a[1])
            j, i = np.divmod(np.flatnonzero(apart <= MAX_BITS), a.shape[1])
            near = np.bitwise_count(held[lo + i] ^ b[j]).sum(1) <= MAX_BITS
            if near.any():
                out.append((lo + i[near], at + j[near]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _groups(contents: DataFrame) -> DataFrame:
    """(no, contents, sizes, descriptors): each different content once, GROUP_CONTENTS or GROUP_BYTES to a row; no is one of
    its contents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ds, size = [], [], 0

        def flush() -> pa.RecordBatch:
            cols = [pa.array([ids[0]], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.array([len(d) // DESCRIPTOR.itemsize for d in ds], np.int64).tobytes()]), pa.array([b"".join(ds)])]
            ids.clear()
            ds.clear()
            return pa.RecordBatch.from_arrays(cols, ["no", "contents", "sizes", "descriptors"])

        for b in batches:
            for content, d in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(content)
                ds.append(d.as_py())
                size += len(ds[-1])
                if len(ids) >= GROUP_CONTENTS or size >= GROUP_BYTES:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    return contents.dropDuplicates(["content"]).mapInArrow(handing_back(pack), "no long, contents binary, sizes binary, descriptors binary")


def _all_links(contents: DataFrame) -> DataFrame:
    """Every pair (a, b), a > b, of contents with MIN_VOTES matches on one placement, written. Each pair of groups is a row
    of a cross join, whose tasks read the groups from where they are written: nothing is dealt out for it, so its disk is
    that of the contents."""
    groups = written(_groups(contents), "image-groups")
    side = lambda n: groups.select(*[F.col(c).alias(f"{n}_{c}") for c in groups.columns])
    met = side("x").join(side("y").hint("shuffle_replicate_nl"), F.col("x_no") >= F.col("y_no"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in slices([batch], 1):
                values = [c[0] for c in row.columns]
                (no, *x), (other, *y) = values[:4], values[4:]
                (a, of_a, da), (b, of_b, db) = (_group(*(v.as_buffer() for v in g)) for g in (x, y))
                i, j = _matches(da["bits"].view("<u8"), db["bits"].view("<u8"))
                pairs, votes = np.unique(of_a[i] * len(b) + of_b[j], return_counts=True)
                out, starts_a, starts_b = [], np.searchsorted(of_a, np.arange(len(a) + 1)), np.searchsorted(of_b, np.arange(len(b) + 1))
                for p, q in zip(*np.divmod(pairs[votes >= MIN_VOTES], len(b)), strict=True):
                    one, two = (a[p], da[starts_a[p] : starts_a[p + 1]]), (b[q], db[starts_b[q] : starts_b[q + 1]])
                    if one[0] < two[0]:
                        if no.as_py() == other.as_py():  # a pair of one group is met twice
                            continue
                        one, two = two, one
                    if one[0] != two[0] and placements(one[1], two[1]) >= MIN_VOTES:
                        out.append((one[0], two[0]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return written(met.mapInArrow(handing_back(compare), "a long, b long"), "image-links", PAIRS_AT_ONCE)


def _group(contents, sizes, descriptors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contents of a row of _groups, whose each descriptor is, and the descriptors."""
    ids = np.frombuffer(contents, np.int64)
    return ids, np.repeat(np.arange(len(ids)), np.frombuffer(sizes, np.int64)), np.frombuffer(descriptors, DESCRIPTOR)


def _links(contents: DataFrame) -> DataFrame:
    """Every candidate pair (a, b), a > b, with MIN_VOTES matches on one placement."""
    pairs = written(_candidates(contents).distinct(), "pairs")
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct(), "pair-ends")
    held = written(contents.join(broadcast_if_small(ends), "content", "left_semi").dropDuplicates(["content"]), "pair-descriptors")
    side = lambda n: held.select(F.col("content").alias(n), F.col("d").alias(f"{n}_d"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(d.as_buffer(), DESCRIPTOR) for d in b.column(i)] for i in (2, 3))
            ok = pa.array([placements(p, q) >= MIN_VOTES for p, q in zip(x, y, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(ok)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_d", "b_d").mapInArrow(verify, "a long, b long")


def image_copies(images: DataFrame, exact: bool = True) -> DataFrame:
    """(image_id, width, height, pixels: grey bytes by row) -> image_id, n_links, component_id (the least id reachable).

    Images of equal content fall together before anything is compared. Null pixels and sizes that don't fit link with
    nothing; null ids stay null. n_links counts the other contents an image's content links with, each compared with it
    directly; a large group of linked contents takes the square of its size. All contents are compared with each other,
    in bounded memory; without exact, only those that share MIN_SHARED pieces, which misses weak links. Repeated rows
    each give a row; an empty table gives an empty result; other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows, todo = [], {}
            for i, w, h, px in zip(*(c.to_pylist() for c in b.columns), strict=True):
                content = xxhash.xxh3_64_intdigest((px or b"") + f"{w}x{h}".encode())
                content -= content >> 63 << 64
                if px and w and h and len(px) == w * h and content not in seen:
                    seen.add(content)
                    todo.setdefault((h, w), []).append((len(rows), px))
                rows.append([i, content, None])
            for (h, w), same in todo.items():
                step = max(1, PIXELS_AT_ONCE // (h * w))
                for lo in range(0, len(same), step):
                    part = same[lo : lo + step]
                    stack = np.frombuffer(b"".join(px for _, px in part), np.uint8).reshape(len(part), h, w)
                    for (row, _), d in zip(part, describe(stack), strict=True):
                        rows[row][2] = d.tobytes() if len(d) else None
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["image_id", "content", "d"])

    plain = images.select(F.col("image_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), F.col("pixels"))
    found = written(plain.mapInArrow(read, "image_id long, content long, d binary"), "descriptors")
    members = found.select("image_id", "content")
    links = _all_links(_contents(found)) if exact else written(_links(_contents(found)), "image-links")
    comps = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("content")).groupBy("content").agg(F.count("*").alias("n_links"))
    contents = members.groupBy("content").agg(F.min("image_id").alias("least"))
    roots = contents.join(comps.withColumnRenamed("node", "content"), "content", "left").withColumn("comp", F.coalesce("comp", "content"))
    classes = roots.join(roots.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").join(degree, "content", "left")
    classes = written(classes.select("content", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    return members.join(broadcast_if_small(classes), "content").select("image_id", "n_links", "component_id")


def render(seed: int, size: int = 64) -> np.ndarray:
    """A grey image that depends on the seed: boxes on a ground of coarse and fine texture."""
    rng = np.random.default_rng(seed & (1 << 63) - 1)
    out = np.full((size, size), 100.0)
    for step, strength in ((16, 60), (8, 40), (4, 25)):
        n = size // step + 2
        grid, at = rng.uniform(-strength, strength, (n, n)), np.arange(size) / step
        low, part = at.astype(int), at % 1
        rows = grid[low] * (1 - part[:, None]) + grid[low + 1] * part[:, None]
        out += rows[:, low] * (1 - part) + rows[:, low + 1] * part
    for x, y, w, h, v in rng.integers((0, 0, 6, 6, -60), (size - 8, size - 8, 20, 20, 60), (5, 5)).tolist():
        out[y : y + h, x : x + w] += v
    return np.clip(out, 8, 240).astype(np.uint8)


def page_images(pages: DataFrame) -> DataFrame:
    """An image for each page, as the tables hold none: drawn from a hash of the html; every tenth page has an edited
    copy of the image of its own html beside it, under the id -1 - page_id: a crop, a brighter and noisy one, one turned
    by 90 degrees, or one of half the contrast, in turn."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = render(h)
                rows.append((i, 64, 64, a.tobytes()))
                if i is not None and i % 10 == 0:
                    c = edited(a, i // 10 % 4, h)
                    rows.append((-1 - i, c.shape[1], c.shape[0], c.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["image_id", "width", "height", "pixels"])

    seeds = pages.select(F.col("page_id").cast("long"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("h"))
    return seeds.mapInArrow(draw, "image_id long, width int, height int, pixels binary")


def edited(a: np.ndarray, kind: int, seed: int) -> np.ndarray:
    if kind == 0:
        return np.ascontiguousarray(a[5:, 7:])
    if kind == 1:
        noise = np.random.default_rng(seed & (1 << 63) - 1).integers(-3, 4, a.shape)
        return np.clip(a.astype(int) + 12 + noise, 0, 255).astype(np.uint8)
    if kind == 2:
        return np.ascontiguousarray(np.rot90(a))
    return np.clip(a.astype(int) // 2 + 50, 0, 255).astype(np.uint8)
