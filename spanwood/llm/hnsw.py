"""A hierarchical navigable small-world graph in numpy (Malkov and Yashunin, 2018), built and searched by batches.

Vectors within half the link angle of a node join that node's bundle and are not nodes themselves: any two of a bundle
are within the link angle of each other by the triangle inequality, so a dense group costs one node and no pairs.
"""

from __future__ import annotations

import io

import numpy as np

#: Links of a node in the lowest layer and in the others, width of the beam while building, vectors in a batch.
LOW, HIGH, BUILD, BATCH = 32, 16, 48, 512
#: Width of the beam before any audit.
FIRST = 16
#: Candidates that a search expands at a time, and queries that it runs side by side.
WIDE, BESIDE = 4, 256


class Graph:
    def __init__(self, raw: np.ndarray, threshold: float = 0.9, seed: int = 11):
        """raw: rows of floats, none of them zero. threshold: least cosine of a link."""
        self.raw = raw
        self.angle = float(np.arccos(threshold))
        self.unit = self._unit(raw).astype(np.float32)
        n = len(raw)
        rng = np.random.default_rng(seed)
        self.level = np.minimum(rng.exponential(1 / np.log(HIGH), n).astype(np.int64), 6)
        self.links = [np.full((n, LOW if k == 0 else HIGH), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.bundle = np.full(n, -1, np.int32)
        self.entry, self.top = -1, -1
        self.beam = FIRST
        near = np.float32(np.cos(self.angle / 2 * 0.999))
        at, nodes = 0, 0
        while at < n:
            size = min(n - at, max(64, min(BATCH, nodes)))
            nodes += self._insert(np.arange(at, at + size), near)
            at += size
        # order of bundles: members of each node, and its radius
        self.order = np.argsort(self.bundle, kind="stable").astype(np.int32)
        self.starts = np.searchsorted(self.bundle[self.order], np.arange(n + 1)).astype(np.int32)
        cos = np.einsum("ij,ij->i", self._unit(raw), self._unit(raw[self.bundle]))
        self.radius = np.zeros(n)
        np.maximum.at(self.radius, self.bundle, np.where(self.bundle == np.arange(n), 0, np.arccos(np.clip(cos, -1, 1)) + 1e-9))
        self.stray = self._strays()

    def _strays(self) -> np.ndarray:
        """Nodes that no walk in the lowest layer reaches from the entry: a search compares them one by one."""
        reached = self.bundle != np.arange(len(self.raw))
        front = np.array([self.entry] if self.entry >= 0 else [], np.int64)
        while len(front):
            reached[front] = True
            near = np.unique(self.links[0][front])
            near = near[near >= 0]
            front = near[~reached[near]]
        return np.flatnonzero(~reached)

    @staticmethod
    def _unit(raw: np.ndarray) -> np.ndarray:
        wide = raw.astype(np.float64)
        wide /= np.abs(wide).max(axis=1, keepdims=True)  # else very large or small components leave the range
        return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]

    def _insert(self, batch: np.ndarray, near: np.float32) -> int:
        unit = self.unit[batch]
        among = unit @ unit.T
        entry = np.full(len(batch), self.entry)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for layer in range(self.top, -1, -1):
            width = BUILD if layer <= int(self.level[batch].max()) else 1
            ids, sims = self._search(unit, entry, layer, width)
            found.append((ids, sims))
            entry = ids[:, 0]
        # bundles: of a node already there, or of an earlier one of this batch
        is_node = np.ones(len(batch), bool)
        if found:
            ids, sims = found[-1]
            joins = sims[:, 0] >= near
            self.bundle[batch[joins]] = ids[joins, 0]
            is_node &= ~joins
        close = np.triu(among >= near, 1).any(axis=1) & is_node
        for i in np.flatnonzero(close):
            if is_node[i]:
                own = np.flatnonzero((among[i, i + 1 :] >= near) & is_node[i + 1 :]) + i + 1
                self.bundle[batch[own]] = batch[i]
                is_node[own] = False
        new = batch[is_node]
        self.bundle[new] = new
        for layer in range(int(self.level[new].max(initial=-1)), -1, -1):
            here = np.flatnonzero(is_node & (self.level[batch] >= layer))
            if not len(here):
                continue
            mates = among[np.ix_(here, here)].copy()
            np.fill_diagonal(mates, -np.inf)
            k = min(BUILD, len(here))
            pick = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            ids, sims = batch[here][pick], np.take_along_axis(mates, pick, 1)
            if layer <= self.top:
                own_ids, own_sims = found[self.top - layer]
                ids, sims = np.hstack([ids, own_ids[here]]), np.hstack([sims, own_sims[here]])
            self._connect(batch[here], ids, sims, layer)
        if len(new):
            high = new[np.argmax(self.level[new])]
            if self.level[high] > self.top:
                self.entry, self.top = int(high), int(self.level[high])
        return len(new)

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        links = self.links[layer]
        kept = self._diverse(ids, sims, links.shape[1] // 2)
        links[nodes, : kept.shape[1]] = kept
        # the other way: what comes to each node, best first, against what it has
        to, frm = kept.ravel(), np.repeat(nodes, kept.shape[1])
        there = to >= 0
        to, frm = to[there], frm[there]
        sim = np.einsum("ij,ij->i", self.unit[to], self.unit[frm])
        order = np.lexsort((-sim, to))
        to, frm = to[order], frm[order]
        first = np.r_[True, to[1:] != to[:-1]] if len(to) else np.zeros(0, bool)
        rank = np.arange(len(to)) - np.maximum.accumulate(np.where(first, np.arange(len(to)), 0))
        width = links.shape[1]
        fits = rank < width
        to, frm, rank = to[fits], frm[fits], rank[fits]
        targets, row = np.unique(to, return_inverse=True)
        if not len(targets):
            return
        both = np.full((len(targets), 2 * width), -1, np.int64)
        both[:, :width] = links[targets]
        both[row, width + rank] = frm
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        sims = np.einsum("id,ijd->ij", self.unit[targets], self.unit[both], optimize=True)
        sims[both < 0] = -np.inf
        crowded = (both >= 0).sum(axis=1) > width
        out = np.full((len(targets), width), -1, np.int64)
        plain = ~crowded
        top = np.argsort(-sims[plain], axis=1)[:, :width]
        out[plain] = np.take_along_axis(both[plain], top, 1)
        if crowded.any():
            out[crowded] = self._diverse(both[crowded], sims[crowded], width)
        links[targets] = out

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Up to `keep` of each row's candidates: those nearer to the row than to any taken before, then the nearest rest."""
        order = np.argsort(-sims, axis=1)[:, : max(BUILD, keep)]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids = np.where(np.isfinite(sims), ids, -1)
        vec = self.unit[ids]
        cross = np.matmul(vec, vec.transpose(0, 2, 1))
        n, c = ids.shape
        taken, worst, count = np.zeros((n, c), bool), np.full((n, c), -np.inf, np.float32), np.zeros(n, np.int64)
        for j in range(c):
            good = (sims[:, j] > worst[:, j]) & (count < keep) & (ids[:, j] >= 0)
            taken[good, j] = True
            count += good
            worst[good] = np.maximum(worst[good], cross[good, j])
        score = np.where(ids >= 0, np.where(taken, 4.0, 0.0) + sims, -np.inf)
        top = np.argsort(-score, axis=1)[:, :keep]
        return np.where(np.take_along_axis(score, top, 1) > -np.inf, np.take_along_axis(ids, top, 1), -1)

    def _search(self, unit: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest nodes that a beam of that width meets in a layer, best first (-1, -inf where fewer)."""
        out = [self._beamed(unit[a : a + BESIDE], entry[a : a + BESIDE], layer, width) for a in range(0, len(unit), BESIDE)]
        return np.vstack([o[0] for o in out]), np.vstack([o[1] for o in out])

    def _beamed(self, unit: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        b, links = len(unit), self.links[layer]
        seen = np.zeros((b, len(self.raw)), bool)
        ids, sims, done = np.full((b, width), -1, np.int64), np.full((b, width), -np.inf, np.float32), np.ones((b, width), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", unit, self.unit[entry]), False
        seen[np.arange(b), entry] = True
        live = np.arange(b)
        wide = min(WIDE, width)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-open_, wide - 1, axis=1)[:, :wide] if width > wide else np.argsort(-open_, axis=1)
            ready = np.take_along_axis(open_, pick, 1) > -np.inf
            on = ready.any(axis=1)
            live, pick, ready = live[on], pick[on], ready[on]
            if not len(live):
                break
            rows = live[:, None]
            done[rows, pick] = True
            near = links[np.where(ready, ids[rows, pick], 0)].astype(np.int64)
            near[~ready] = -1
            near = near.reshape(len(live), -1)
            fresh = (near >= 0) & ~seen[rows, near]
            near = np.sort(np.where(fresh, near, -1), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near.sort(axis=1)
            most = int((near >= 0).sum(axis=1).max(initial=0))
            if not most:
                continue
            near = near[:, near.shape[1] - most :]
            at, col = np.nonzero(near >= 0)
            node = near[at, col]
            seen[live[at], node] = True
            sim = np.full(near.shape, -np.inf, np.float32)
            sim[at, col] = np.einsum("ij,ij->i", unit[live[at]], self.unit[node])
            all_ids, all_sims = np.hstack([ids[live], near]), np.hstack([sims[live], sim])
            all_done = np.hstack([done[live], near < 0])
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live], done[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_done, top, 1)
        order = np.argsort(-sims, axis=1)
        return np.where(np.take_along_axis(sims, order, 1) > -np.inf, np.take_along_axis(ids, order, 1), -1), np.take_along_axis(sims, order, 1)

    def nearest(self, unit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full(len(unit), self.entry)
        for layer in range(self.top, 0, -1):
            entry = self._search(unit, entry, layer, 1)[0][:, 0]
        return self._search(unit, entry, 0, width)

    def audit(self, recall: float, sample: int = 256, seed: int = 5) -> float:
        """Widen the beam until, of sampled queries, this share meets every node that brute force links it with; the share.

        Queries are `sample` rows, as many members of bundles, and both turned away to just within the link angle. A beam
        that would hold all nodes compares them all, so that no share can stay below `recall` for good.
        """
        self.stray = self._strays()
        rng = np.random.default_rng(seed)
        members = np.flatnonzero(self.bundle != np.arange(len(self.raw)))
        chosen = np.concatenate([rng.choice(own, min(sample, len(own)), replace=False) for own in (np.arange(len(self.raw)), members) if len(own)])
        unit = self.unit[chosen]
        away = rng.normal(size=unit.shape).astype(np.float32)
        away -= np.einsum("ij,ij->i", away, unit)[:, None] * unit
        away /= np.maximum(np.sqrt(np.einsum("ij,ij->i", away, away)), 1e-30)[:, None]
        angle = self.angle * 0.999
        asked = np.vstack([unit, unit * np.float32(np.cos(angle)) + away * np.float32(np.sin(angle))])
        wanted = [np.unique(self.bundle[near]) for a in range(0, len(asked), BESIDE) for near in asked[a : a + BESIDE] @ self.unit.T >= np.cos(self.angle)]
        nodes = np.flatnonzero(self.bundle == np.arange(len(self.raw)))
        while True:
            met = self._met(asked, nodes)
            share = float(np.mean([np.isin(w, m).all() for w, m in zip(wanted, met, strict=True)]))
            if share >= recall or self.beam >= len(nodes):
                return share
            self.beam = max(self.beam + 1, int(self.beam * 1.5))

    def _met(self, unit: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
        """For each row of unit: the nodes within whose reach it is, the link angle and the node's own radius.

        A beam whose last node is no farther than the widest reach may hide nodes behind it, whatever its own reach: such
        rows are compared with all nodes, as are all rows where the beam would hold them all.
        """
        # a little under the bound: searches are in single precision
        reach = (np.cos(np.minimum(np.pi, self.angle + self.radius)) - 1e-5).astype(np.float32)
        out: list = [None] * len(unit)
        todo = np.arange(len(unit))
        if self.beam < len(nodes):
            ids, sims = self.nearest(unit, self.beam)
            within = (ids >= 0) & (sims >= reach[ids])
            full = (ids[:, -1] < 0) | (sims[:, -1] >= reach[nodes].min())
            lone = unit @ self.unit[self.stray].T >= reach[self.stray]
            for i in np.flatnonzero(~full):
                out[i] = np.union1d(ids[i][within[i]], self.stray[lone[i]])
            todo = np.flatnonzero(full)
        vectors, least = self.unit[nodes], reach[nodes]
        for a in range(0, len(todo), BESIDE):
            for i, near in zip(todo[a : a + BESIDE], unit[todo[a : a + BESIDE]] @ vectors.T >= least, strict=True):
                out[i] = nodes[near]
        return out

    def linked(self, raw: np.ndarray, weight: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row of raw: the nodes in whose bundles it has links, and the weight of the rows it links with there.

        own: the row's own place in this graph, or -1.
        """
        unit = self._unit(raw)
        out = []
        # a closing zero keeps the last bundle whole where places without members follow it
        sums = np.add.reduceat(np.append(weight[self.order], 0), self.starts[:-1]) * (self.starts[1:] > self.starts[:-1])
        for q, nodes in enumerate(self._met(unit.astype(np.float32), np.flatnonzero(self.bundle == np.arange(len(self.raw))))):
            if own[q] >= 0:
                nodes = np.union1d(nodes, [self.bundle[own[q]]])
            out.append(self._counted(unit[q], nodes, weight, sums, own[q]))
        return out

    def _counted(self, q: np.ndarray, nodes: np.ndarray, weight: np.ndarray, sums: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        cos = self._unit(self.raw[nodes]) @ q if len(nodes) else np.zeros(0)
        angle = np.arccos(np.clip(cos, -1, 1))
        n = np.zeros(len(nodes), np.int64)
        for k, node in enumerate(nodes):
            mine = own >= 0 and self.bundle[own] == node
            if mine or angle[k] + self.radius[node] < self.angle - 1e-9:
                n[k] = sums[node]
            elif angle[k] - self.radius[node] <= self.angle + 1e-9:
                members = self.order[self.starts[node] : self.starts[node + 1]]
                n[k] = weight[members[self._unit(self.raw[members]) @ q >= np.cos(self.angle)]].sum()
        return nodes[n > 0], n[n > 0]

    def dump(self) -> bytes:
        f = io.BytesIO()
        rest = {f"links{k}": x for k, x in enumerate(self.links)}
        np.savez(f, raw=self.raw, level=self.level.astype(np.int8), bundle=self.bundle, order=self.order, starts=self.starts, radius=self.radius, stray=self.stray, numbers=np.array([self.entry, self.top, self.beam]), angle=self.angle, **rest)
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        g = cls.__new__(cls)
        g.raw, g.level, g.bundle, g.order, g.starts, g.radius, g.stray, g.angle = z["raw"], z["level"], z["bundle"], z["order"], z["starts"], z["radius"], z["stray"], float(z["angle"])
        g.entry, g.top, g.beam = map(int, z["numbers"])
        g.links = [z[f"links{k}"] for k in range(sum(x.startswith("links") for x in z.files))]
        g.unit = cls._unit(g.raw).astype(np.float32)
        return g
