"""Stupid-backoff language model scores from count tables of the corpus itself.

Documents are dealt into blocks. Each block is exploded into its distinct n-grams with their counts
and sends them to tables partitioned by hash, which sum over all blocks; the totals are joined back
to the blocks that asked, where every word of a document is scored and summed. A document's own
occurrences are taken off first, so a text is judged by all others and not by itself.

Most n-grams of two words or more stand in one block only, whose own count is the total. Blocks
first send the leading bits of the hashes, just enough to tell nearly all n-grams apart, and learn
which bits another block sent too; the other bits of the hashes and the counts follow for those
alone, and meet the leading bits in the table. No total changes.

Blocks and table partitions hold a fixed amount of text each, so their number, and what is
shuffled, grow with the input; an n-gram enters a table once per block, however frequent it is. The
n-grams travel as packed arrays, since rows of their own take twice the disk; sorted leading bits
are delta-coded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import gram_hashes, hashed_words, importable

BLOCK_CHARS = 4_000_000
TABLE_WORDS = 1_500_000
SPARE_BITS = 3               # leading bits beyond those that number all words
LEADING = "block bigint, size int, part int, leading binary"
SHARED = "block bigint, size int, part int, shared binary"
REQUEST = "block bigint, size int, part int, shared binary, again binary, rest binary, counts binary"
ANSWER = "block bigint, size int, part int, shared binary, totals binary"
SCORE = "n_words bigint, log_score double, mean_log_score double, n_backed_off bigint"


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers, first bytes first: what sorted numbers share compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, dtype) -> np.ndarray:
    if not raw:
        return np.empty(0, dtype)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype)[:, 0]


def _sorted_bytes(x: np.ndarray) -> bytes:
    """Ascending numbers by Elias and Fano: steps of the high bits in unary, then the low bits."""
    if not len(x):
        return b""
    steps = x - x[0]
    low = (int(steps[-1]) // len(x)).bit_length()
    high = (steps >> np.uint64(low)).astype(np.int64) + np.arange(len(x))
    unary = np.zeros(high[-1] + 1, bool)
    unary[high] = True
    whole, rest = divmod(low, 8)
    raw = steps.view(np.uint8).reshape(len(x), -1)
    head = np.array([x[0], len(x), low], np.uint64).tobytes()
    bits = np.unpackbits(raw[:, whole, None], axis=1, bitorder="little")[:, :rest]
    return b"".join((head, np.packbits(bits).tobytes(), raw[:, :whole].T.tobytes(),
                     np.packbits(unary).tobytes()))


def _sorted_numbers(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    first, n, low = map(int, np.frombuffer(raw, np.uint64, 3))
    whole, rest = divmod(low, 8)
    data = np.frombuffer(raw, np.uint8, offset=24)
    a = -(-n * rest // 8)
    b = a + n * whole
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :whole] = data[a:b].reshape(whole, n).T
    bits = np.unpackbits(data[:a], count=n * rest).reshape(n, rest)
    if rest:
        steps[:, whole] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
    high = np.flatnonzero(np.unpackbits(data[b:])) - np.arange(n)
    return (high.astype(np.uint64) << np.uint64(low)) + steps.view(np.uint64)[:, 0] + np.uint64(first)


def _low_bytes(x: np.ndarray, bits: int) -> bytes:
    """The last ``bits`` bits of the numbers: whole bytes in planes, then the bits that are left."""
    whole, odd = divmod(bits, 8)
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
    left = np.unpackbits(raw[:, whole, None], axis=1, bitorder="little")[:, :odd] if odd else raw[:, :0]
    return raw[:, :whole].T.tobytes() + np.packbits(left).tobytes()


def _low_numbers(raw: bytes, n: int, bits: int) -> np.ndarray:
    whole, odd = divmod(bits, 8)
    data, out = np.frombuffer(raw, np.uint8), np.zeros((n, 8), np.uint8)
    out[:, :whole] = data[:n * whole].reshape(whole, n).T
    if odd:
        left = np.unpackbits(data[n * whole:], count=n * odd).reshape(n, odd)
        out[:, whole] = np.packbits(left, axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def _count_bytes(x: np.ndarray) -> bytes:
    """Counts from 1 on: a bit each tells which are above 1, and these follow."""
    more = x > 1
    return np.packbits(more).tobytes() + _planes(x[more].astype(np.uint32))


def _count_numbers(raw: bytes, n: int) -> np.ndarray:
    out, flags = np.ones(n, np.uint32), -(-n // 8)
    more = np.unpackbits(np.frombuffer(raw[:flags], np.uint8), count=n).astype(bool)
    out[more] = _numbers(raw[flags:], np.uint32)
    return out


def _grams(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a block, and the place of the last word of each."""
    grams = gram_hashes(hashes, size)
    starts = np.arange(len(grams))
    text = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + size <= bounds[text + 1]
    return grams[inside], starts[inside] + size - 1


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; ``np.unique`` hashes them first, which is slow where most differ."""
    x = np.sort(x)
    return x[np.diff(x, prepend=~x[:1]) != 0]


def _part(grams: np.ndarray, parts: int) -> np.ndarray:
    """Table partition of each hash: ascending, as the hashes are."""
    return ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _leading(grams: np.ndarray, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading bits of sorted hashes, each once a partition; which of them each hash has; partitions."""
    part, bits_of = _part(grams, parts), grams >> np.uint64(64 - bits)
    new = np.ones(len(grams), bool)
    new[1:] = (bits_of[1:] != bits_of[:-1]) | (part[1:] != part[:-1])
    return bits_of[new], np.cumsum(new) - 1, part


def _cuts(part: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    cuts = np.searchsorted(part, np.arange(parts + 1))
    return [(p, slice(cuts[p], cuts[p + 1])) for p in np.flatnonzero(np.diff(cuts)).tolist()]


def _announced(block: int, table: pa.Table, order: int, parts: int, bits: int) -> pa.Table:
    hashes, bounds = hashed_words(table.column("text").combine_chunks())
    rows = []
    for size in range(1, order + 1):
        leading, which, part = _leading(_distinct(_grams(hashes, bounds, size)[0]), parts, bits)
        first = np.flatnonzero(np.diff(which, prepend=-1))
        rows += [(block, size, p, _sorted_bytes(leading[some]))
                 for p, some in _cuts(part[first], parts)]
    return _table(rows, LEADING)


def _seen_twice(table: pa.Table) -> pa.Table:
    """Tell each block which of its leading bits another block has too."""
    leading = [_sorted_numbers(raw) for raw in table.column("leading").to_pylist()]
    _, where, count = np.unique(np.concatenate(leading), return_inverse=True, return_counts=True)
    shared = np.split(count[where] > 1, np.cumsum([len(x) for x in leading])[:-1])
    rows = zip(table.column("block").to_pylist(), table.column("size").to_pylist(),
               table.column("part").to_pylist(), (np.packbits(x).tobytes() for x in shared))
    return _table(list(rows), SHARED)


def _shared(grams: np.ndarray, raw: dict[int, bytes], parts: int, bits: int) -> tuple:
    """Which sorted hashes of one size may stand in another block; the partition of each."""
    leading, which, part = _leading(grams, parts, bits)
    first = np.flatnonzero(np.diff(which, prepend=-1))
    told = np.zeros(len(leading), bool)
    for p, some in _cuts(part[first], parts):
        told[some] = np.unpackbits(np.frombuffer(raw[p], np.uint8), count=some.stop - some.start)
    return told[which], part


def _by_size(table: pa.Table, column: str) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for size, part, raw in zip(table.column("size").to_pylist(), table.column("part").to_pylist(),
                               table.column(column).to_pylist()):
        out.setdefault(size, {})[part] = raw
    return out


def _requests(table: pa.Table, told: pa.Table, order: int, parts: int, bits: int) -> pa.Table:
    hashes, bounds = hashed_words(table.column("text").combine_chunks())
    raw, rows = _by_size(told, "shared"), []
    for size in raw:
        grams, counts = np.unique(_grams(hashes, bounds, size)[0], return_counts=True)
        shared, part = _shared(grams, raw[size], parts, bits)
        block = told.column("block")[0].as_py()
        for p, some in _cuts(part, parts):
            mine = grams[some][shared[some]]
            first = mine >> np.uint64(64 - bits)
            again = np.flatnonzero(first[1:] == first[:-1]) + 1
            rows.append((block, size, p, raw[size][p], _sorted_bytes(again.astype(np.uint64)),
                         _low_bytes(mine, 64 - bits), _count_bytes(counts[some][shared[some]])))
    return _table(rows, REQUEST)


def _asked(leading: bytes, shared: bytes, again: bytes, rest: bytes, bits: int) -> np.ndarray:
    """Hashes of a request: the leading bits that another block sent too, each with its other bits.

    ``again`` are the places of hashes that have the same leading bits as the one before.
    """
    known = _sorted_numbers(leading)
    known = known[np.unpackbits(np.frombuffer(shared, np.uint8), count=len(known)).astype(bool)]
    repeated = _sorted_numbers(again).astype(np.int64)
    new = np.ones(len(known) + len(repeated), bool)
    new[repeated] = False
    known = known[np.cumsum(new) - 1] << np.uint64(64 - bits)
    return known | _low_numbers(rest, len(new), 64 - bits)


def _answers(table: pa.Table, leading: pa.Table, bits: int) -> pa.Table:
    """Sum one partition of a count table and answer each block in its own order."""
    sent = dict(zip(leading.column("block").to_pylist(), leading.column("leading").to_pylist()))
    grams = [_asked(sent[block], shared, again, rest, bits) for block, shared, again, rest in zip(
        *(table.column(c).to_pylist() for c in ("block", "shared", "again", "rest")))]
    counts = [_count_numbers(c, len(g)) for c, g in zip(table.column("counts").to_pylist(), grams)]
    distinct, where = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.uint64)[where]
    ends = np.cumsum([len(g) for g in grams])[:-1]
    rows = zip(table.column("block").to_pylist(), table.column("size").to_pylist(),
               table.column("part").to_pylist(), table.column("shared").to_pylist(),
               map(_planes, np.split(totals, ends)))
    return _table(list(rows), ANSWER)


def _totals(grams: np.ndarray, counts: np.ndarray, shared: dict[int, bytes],
            answers: dict[int, bytes], parts: int, bits: int) -> np.ndarray:
    """Totals of the sorted hashes of a block: the answered ones, its own counts elsewhere."""
    out = counts.astype(float)
    if len(grams):
        asked, _ = _shared(grams, shared, parts, bits)
        out[asked] = np.concatenate([_numbers(answers[p], np.uint64) for p in sorted(answers)])
    return out


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [part.split() for part in ddl.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)],
                    names=[name for name, _ in fields])


def _scores(hashes: np.ndarray, bounds: np.ndarray, totals, order: int, words: int,
            backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Log score of every word of a block, and whether it was backed off.

    ``totals`` gives the totals of sorted hashes of one size from these and their own counts.
    """
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    others = np.maximum(words - np.diff(bounds), 1)[text]       # words of all other documents
    score = backed = before = None
    for size in range(1, order + 1):
        grams, last = _grams(hashes, bounds, size)
        # sorted by n-gram, then by place: rows of one text stand together
        order_of = np.argsort(grams, kind="stable")
        sorted_grams, places = grams[order_of], last[order_of]
        new = np.diff(sorted_grams, prepend=~sorted_grams[:1]) != 0
        own = new | (np.diff(text[places], prepend=-1) != 0)
        where, which = np.cumsum(new) - 1, np.cumsum(own) - 1
        left = np.zeros(len(hashes))
        total = totals(size, sorted_grams[new], np.bincount(where))
        left[places] = total[where] - np.bincount(which)[which]
        if size == 1:
            seen = left > 0
            score = np.where(seen, left, 0.5) / others
        else:
            context = np.zeros(len(hashes))
            context[last] = before[last - 1]
            seen = left > 0
            longer = np.zeros(len(hashes), bool)
            longer[last] = True
            score = np.where(seen, left / np.maximum(context, 1), np.where(longer, backoff, 1) * score)
            seen |= ~longer & ~backed
        backed, before = ~seen, left
    return np.log(score), backed


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3,
                   backoff: float = 0.4) -> DataFrame:
    """One row per row: id, ``n_words``, ``log_score`` (natural, summed), its mean per word, and
    ``n_backed_off``, the words whose longest n-gram no other document has.

    The score of a word is the count of its n-gram over that of the context, or ``backoff`` times
    the score of the shorter one; a word that no other document has counts half. Words are
    separated by white space, A-Z in lower case; they never run over the end of a document. Null
    and empty texts have 0 words, score 0 and a null mean. Repeated rows are documents of their
    own, and so raise each other's score.
    """
    importable(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars, words = rows.agg(F.sum(F.length("text")), F.sum(
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    chars, words = int(chars or 0), int(words or 0)
    blocks, parts = max(1, -(-chars // BLOCK_CHARS)), max(1, -(-words // TABLE_WORDS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))

    bits = min(64, words.bit_length() + SPARE_BITS)

    def announce(key, table):
        return _announced(key[0].as_py(), table, order, parts, bits)

    def tell(table):
        return _seen_twice(table)

    def ask(table, told):
        return _requests(table, told, order, parts, bits)

    def answer(table, leading):
        return _answers(table, leading, bits)

    def score(table, answers):
        hashes, bounds = hashed_words(table.column("text").combine_chunks()) if len(table) else (
            np.empty(0, np.uint64), np.zeros(1, np.int64))
        shared, answered = _by_size(answers, "shared"), _by_size(answers, "totals")

        def totals(size, grams, counts):
            return _totals(grams, counts, shared.get(size, {}), answered.get(size, {}), parts, bits)

        n = np.diff(bounds)
        logs, backed = (np.zeros(0), np.zeros(0)) if not len(hashes) else _scores(
            hashes, bounds, totals, order, words, backoff)
        total, missed = (np.diff(np.r_[0, np.cumsum(x)][bounds]) for x in (logs, backed))
        return pa.table({
            id_col: table.column("id"), "n_words": n, "log_score": total,
            "mean_log_score": pa.array(np.where(n > 0, total / np.maximum(n, 1), 0), mask=n == 0),
            "n_backed_off": missed.astype(np.int64)})

    leading = dealt.groupBy("block").applyInArrow(announce, LEADING)
    told = leading.groupBy("size", "part").applyInArrow(tell, SHARED)
    asked = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask, REQUEST)
    answered = asked.groupBy("size", "part").cogroup(leading.groupBy("size", "part")).applyInArrow(
        answer, ANSWER)
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        score, f"`{id_col}` {kind}, {SCORE}")
