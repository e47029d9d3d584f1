"""Hierarchical navigable small-world graphs in numpy; inserts and searches run over many vectors at a time."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np

#: Links of a node in the lowest layer, links it makes when it is inserted (and has in upper layers), beam of an insert.
WIDTH, LINKS, BEAM = 32, 16, 48


class Layer:
    """A proximity graph over unit vectors; `nbr` holds node numbers, -1 for none."""

    def __init__(self, vectors: np.ndarray, width: int, nbr: np.ndarray | None = None):
        self.v, self.width = vectors, width
        self.nbr = np.full((len(vectors), width), -1, np.int32) if nbr is None else nbr

    def search(self, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of each query's beam, best first, -1 where there are fewer than ef."""
        rows, wall = len(q), len(self.v) + 1
        k = min(wide, ef)
        first = entry[:, :ef]
        good = first >= 0
        ids = np.full((rows, ef), -1, np.int32)
        sims = np.full((rows, ef), -2, np.float32)
        ids[:, : first.shape[1]] = first
        sims[:, : first.shape[1]] = np.where(good, np.einsum("bed,bd->be", self.v[first], q), -2)
        out_ids, out_sims = ids.copy(), sims.copy()
        todo = np.where(ids >= 0, sims, -3)  # what is still to be expanded
        fresh = np.ones(rows * wall, bool)  # a row a query; its first place stands for no node
        base = np.arange(rows, dtype=np.int64) * wall + 1
        fresh[base - 1] = False
        fresh[(first + base[:, None])[good]] = False
        live = np.arange(rows)
        while len(live):
            pick = np.argpartition(todo, ef - k, axis=1)[:, ef - k :] if k < ef else np.broadcast_to(np.arange(ef), todo.shape)
            value = np.take_along_axis(todo, pick, 1)
            going = value.max(1) > -3
            if not going.all():
                out_ids[live[~going]], out_sims[live[~going]] = ids[~going], sims[~going]
                live, pick, value, ids, sims, todo, base, q = (x[going] for x in (live, pick, value, ids, sims, todo, base, q))
                if not len(live):
                    break
            near = self.nbr.take(np.take_along_axis(ids, pick, 1), axis=0)
            near[value <= -3] = -1
            np.put_along_axis(todo, pick, -3, 1)
            at = near.reshape(len(live), -1) + base[:, None]
            at = np.sort(at[fresh.take(at)])
            if not len(at):
                continue
            at = at[np.append(True, at[1:] != at[:-1])]
            fresh[at] = False
            r = np.searchsorted(base, at, "right") - 1
            found = at - base[r]
            value = np.einsum("nd,nd->n", self.v.take(found, axis=0), q.take(r, axis=0))
            better = value > sims.min(1)[r]
            r, found, value = r[better], found[better], value[better]
            count = np.bincount(r, minlength=len(live))
            most = int(count.max())
            if not most:
                continue
            place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            more_ids, more_sims, more_todo = np.full((len(live), most), -1, np.int32), np.full((len(live), most), -2, np.float32), np.full((len(live), most), -3, np.float32)
            more_ids[r, place], more_sims[r, place], more_todo[r, place] = found, value, value
            all_sims = np.concatenate((sims, more_sims), 1)
            top = np.argpartition(all_sims, most, axis=1)[:, most:]
            ids, sims, todo = (np.take_along_axis(x, top, 1) for x in (np.concatenate((ids, more_ids), 1), all_sims, np.concatenate((todo, more_todo), 1)))
        order = np.argsort(-out_sims, axis=1, kind="stable")
        return np.take_along_axis(out_ids, order, 1), np.take_along_axis(out_sims, order, 1)

    def choose(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """The links to keep of candidates in order: first those nearer to the node than to any kept one, then the rest."""
        v = self.v[ids]
        pair = v @ v.transpose(0, 2, 1)
        valid = ids >= 0
        kept, near, count = np.zeros(ids.shape, bool), np.full(ids.shape, -2, np.float32), np.zeros(len(ids), np.int64)
        for c in range(ids.shape[1]):
            ok = valid[:, c] & (count < width) & (sims[:, c] > near[:, c])
            kept[:, c] = ok
            count += ok
            near = np.where(ok[:, None], np.maximum(near, pair[:, c]), near)
        rank = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :width]
        return np.take_along_axis(np.where(valid, ids, -1), rank, 1)

    def link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Connects new nodes with their candidates, both ways; full nodes choose anew."""
        links = self.choose(ids, sims, min(LINKS, self.width))
        self.nbr[nodes, : links.shape[1]] = links
        r, c = np.nonzero(links >= 0)
        old, new = links[r, c], nodes[r]
        order = np.argsort(old, kind="stable")
        old, new = old[order], new[order]
        target, start, number = np.unique(old, return_index=True, return_counts=True)
        most = min(int(number.max(initial=1)), self.width)
        come = np.full((len(target), most), -1, np.int32)
        place = np.arange(len(old)) - np.repeat(start, number)
        fits = place < most
        come[np.repeat(np.arange(len(target)), number)[fits], place[fits]] = new[fits]
        have = (self.nbr[target] >= 0).sum(1)
        easy = have + number <= self.width
        for k in range(most):
            some = easy & (come[:, k] >= 0)
            self.nbr[target[some], have[some] + k] = come[some, k]
        for some in np.array_split(np.flatnonzero(~easy), max(1, int((~easy).sum()) // 1024)):
            if len(some):
                both = np.concatenate((self.nbr[target[some]], come[some]), 1)
                s = np.where(both >= 0, np.einsum("bed,bd->be", self.v[both], self.v[target[some]]), -2)
                order = np.argsort(-s, axis=1, kind="stable")
                self.nbr[target[some]] = self.choose(np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1), self.width)


class Graph:
    """Layers from the top down; `down[k]` are the places of layer k's nodes in the layer below."""

    def __init__(self, layers: list[Layer], down: list[np.ndarray]):
        self.layers, self.down = layers, down

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        n = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int) if n else np.zeros(0, int)
        members = [np.flatnonzero(level >= k) for k in range(int(level.max(initial=0)), -1, -1)]
        layers, down = [], []
        for k, own in enumerate(members):
            layer = Layer(np.ascontiguousarray(vectors[own]), WIDTH if k == len(members) - 1 else LINKS)
            done = np.zeros(0, np.int64)
            if layers:  # nodes of the layer above come first
                done = np.searchsorted(own, members[k - 1])
                down.append(done.astype(np.int32))
            rest = np.setdiff1d(np.arange(len(own)), done)
            cls(layers, down)._insert(layer, np.concatenate((done, np.random.default_rng(seed + 1).permutation(rest))))
            layers.append(layer)
        return cls(layers, down)

    def _insert(self, layer: Layer, order: np.ndarray) -> None:
        first = min(len(order), 128)
        for a, b in [(0, first)] + [(a, min(a + 512, len(order))) for a in range(first, len(order), 512)]:
            new = order[a:b].astype(np.int32)
            among = layer.v[new] @ layer.v[new].T
            np.fill_diagonal(among, -2)
            k = min(LINKS, len(new))
            near = np.argsort(-among, axis=1, kind="stable")[:, :k]
            ids, sims = new[near], np.take_along_axis(among, near, 1)
            ids = np.where(sims > -2, ids, -1)
            if a:
                more, value = layer.search(layer.v[new], self.entries(layer.v[new], layer, order[:a]), BEAM)
                ids, sims = np.concatenate((ids, more), 1), np.concatenate((sims, value), 1)
            rank = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM]
            layer.link(new, np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1))

    def entries(self, q: np.ndarray, layer: Layer | None = None, inserted: np.ndarray | None = None) -> np.ndarray:
        """Entry nodes of the next layer down, by a narrow search of the layers above it."""
        at = None
        for k, upper in enumerate(self.layers if layer is not None else self.layers[:-1]):
            start = np.zeros((len(q), 1), np.int32) if at is None else at
            found = upper.search(q, start, 8)[0][:, :4]
            at = np.where(found >= 0, self.down[k][found], -1)
        if at is None:
            at = np.full((len(q), 1), 0 if inserted is None else inserted[0], np.int32)
        if inserted is not None and len(self.layers) and len(inserted) < len(self.down[-1]):
            known = np.zeros(len(layer.v), bool)
            known[inserted] = True
            at = np.where((at >= 0) & known[at], at, -1)
            at[:, 0] = np.where((at >= 0).any(1), at[:, 0], inserted[0])
        return at

    def steps(self, q: np.ndarray, least: float, ef: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Some queries at a time: (first row, rows from there, nodes with similarity >= least, each query's beam).

        The nodes are the beam's, and all that links among such nodes lead to.
        """
        base = self.layers[-1]
        step = max(1, min(512, (1 << 26) // max(1, len(base.v))))
        for a in range(0, len(q), step):
            some, rows, nodes = q[a : a + step], [], []
            ids, sims = base.search(some, self.entries(some), ef, 8)
            hit = (sims >= least) & (ids >= 0)
            for r in np.flatnonzero(hit.any(1)):
                seen = np.zeros(len(base.v), bool)
                front = ids[r][hit[r]]
                seen[ids[r][ids[r] >= 0]] = True
                kept = [front]
                while len(front):
                    near = np.unique(base.nbr[front])
                    near = near[near >= 0]
                    near = near[~seen[near]]
                    seen[near] = True
                    front = near[base.v[near] @ some[r] >= least]
                    kept.append(front)
                found = np.concatenate(kept)
                rows.append(np.full(len(found), r))
                nodes.append(found)
            empty = np.empty(0, np.int64)
            yield a, np.concatenate(rows) if rows else empty, np.concatenate(nodes) if nodes else empty, ids

    def within(self, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, node) of all steps."""
        found = [(a + rows, nodes) for a, rows, nodes, _ in self.steps(q, least, ef)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def dumps(self) -> bytes:
        """The links; vectors are kept elsewhere."""
        out = io.BytesIO()
        np.savez(out, n=len(self.layers), **{f"l{k}": x.nbr for k, x in enumerate(self.layers)}, **{f"d{k}": x for k, x in enumerate(self.down)})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes, vectors: np.ndarray) -> Graph:
        """A graph over the vectors that it was built from."""
        x = np.load(io.BytesIO(data))
        n = int(x["n"])
        down, own = [x[f"d{k}"] for k in range(n - 1)], [vectors]
        for places in reversed(down):
            own.append(own[-1][places])
        return cls([Layer(v, x[f"l{k}"].shape[1], x[f"l{k}"]) for k, v in enumerate(reversed(own))], down)
