"""BLAKE3 from its published specification, vectorised over chunks with numpy."""

from __future__ import annotations

import numpy as np

# Fixed values of the specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK, BATCH = 1024, 64, 1024


def _compress(cv: np.ndarray, m: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """First half of the compression's output for n inputs at once: cv (8, n), message words m (16, n)."""
    n = cv.shape[1]
    v = np.empty((16, n), dtype=np.uint32)
    v[:8] = cv
    v[8:12] = IV[:4, None]
    v[12] = (counter & 0xFFFFFFFF).astype(np.uint32)
    v[13] = (counter >> np.uint64(32)).astype(np.uint32)
    v[14] = length
    v[15] = flags

    def rot(x: np.ndarray, r: int) -> np.ndarray:
        return (x >> np.uint32(r)) | (x << np.uint32(32 - r))

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        v[a] += v[b] + x
        v[d] = rot(v[d] ^ v[a], 16)
        v[c] += v[d]
        v[b] = rot(v[b] ^ v[c], 12)
        v[a] += v[b] + y
        v[d] = rot(v[d] ^ v[a], 8)
        v[c] += v[d]
        v[b] = rot(v[b] ^ v[c], 7)

    with np.errstate(over="ignore"):
        for r in range(7):
            for col in range(4):
                mix(col, 4 + col, 8 + col, 12 + col, m[2 * col], m[2 * col + 1])
            for k in range(4):
                mix(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
            if r < 6:
                m = m[PERMUTATION]
    return v[:8] ^ v[8:]


def _chunks(data: bytes, first: int, root: bool = False) -> np.ndarray:
    """Chaining values (8, n) of the chunks of data, the first of which has the number ``first``."""
    n = max(1, -(-len(data) // CHUNK))
    padded = np.zeros(n * CHUNK, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    words = padded.view("<u4").reshape(n, 16, 16).astype(np.uint32)
    sizes = np.full(n, CHUNK, dtype=np.int64)
    sizes[-1] = len(data) - (n - 1) * CHUNK
    blocks = np.maximum(1, -(-sizes // BLOCK))
    counter = np.arange(first, first + n, dtype=np.uint64)
    cv = np.repeat(IV[:, None], n, axis=1)
    for b in range(16):
        live = np.flatnonzero(blocks > b)
        if not len(live):
            break
        length = np.minimum(BLOCK, sizes[live] - b * BLOCK).astype(np.uint32)
        end = blocks[live] == b + 1
        flags = (np.where(b == 0, CHUNK_START, 0) | np.where(end, CHUNK_END | (ROOT if root else 0), 0)).astype(np.uint32)
        cv[:, live] = _compress(cv[:, live], words[live, b].T.copy(), counter[live], length, flags)
    return cv


def _parents(cv: np.ndarray, root: bool = False) -> np.ndarray:
    n = cv.shape[1] // 2
    m = np.concatenate([cv[:, 0::2], cv[:, 1::2]], axis=0)
    zero = np.zeros(n, dtype=np.uint64)
    return _compress(np.repeat(IV[:, None], n, axis=1), m, zero, np.full(n, BLOCK, dtype=np.uint32), np.full(n, PARENT | (ROOT if root else 0), dtype=np.uint32))


class Blake3:
    """Streaming hash in bounded memory: whole batches of chunks are reduced to one node each as they come."""

    def __init__(self) -> None:
        self._buffer = bytearray()
        self._stack: list[tuple[int, np.ndarray]] = []  # (chunks, node), a binary counter of complete subtrees
        self._done = 0

    def update(self, data: bytes) -> Blake3:
        self._buffer += data
        while len(self._buffer) > BATCH * CHUNK:
            part = bytes(self._buffer[: BATCH * CHUNK])
            del self._buffer[: BATCH * CHUNK]
            cv = _chunks(part, self._done)
            while cv.shape[1] > 1:
                cv = _parents(cv)
            self._done += BATCH
            size = BATCH
            while self._stack and self._stack[-1][0] == size:
                cv = _parents(np.concatenate([self._stack.pop()[1], cv], axis=1))
                size *= 2
            self._stack.append((size, cv))
        return self

    def digest(self) -> bytes:
        rest = bytes(self._buffer)
        if not self._stack and len(rest) <= CHUNK:
            return _chunks(rest, 0, root=True)[:, 0].astype("<u4").tobytes()
        cv = _chunks(rest, self._done)
        nodes = [n for _, n in self._stack]
        while cv.shape[1] > 1:
            if not nodes and cv.shape[1] == 2:
                break
            even = cv.shape[1] // 2 * 2
            joined = _parents(cv[:, :even])
            cv = np.concatenate([joined, cv[:, even:]], axis=1)
        if cv.shape[1] == 2:
            return _parents(cv, root=True)[:, 0].astype("<u4").tobytes()
        while nodes:
            cv = _parents(np.concatenate([nodes.pop(), cv], axis=1), root=not nodes)
        return cv[:, 0].astype("<u4").tobytes()


def blake3(data: bytes) -> bytes:
    return Blake3().update(data).digest()
