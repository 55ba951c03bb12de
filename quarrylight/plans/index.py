"""The code index (U1-U2, I1-I11): build, patch, search, overview and its sources.

A rebuild is one plan: paths of all git roots and folders, the owning source of
each, texts, items, chunks, vectors.  An update compares each git root's commit
and dirty files with those of the last time and re-reads only what changed.

Where it departs from what it reproduces: the state of a root is kept whenever
its commit moved, also if nothing else changed; untracked folders and names
with spaces are seen; paths are resolved before they are compared with roots; a
file whose embedding fails ends the update instead of being lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import embedding, maintenance, ranking
from ..operators.chunking import build
from ..operators.discovery import claims, discovered
from ..operators.overview import index_result, overviews
from ..sources import config as cfg
from ..sources import git
from .lineage import cut
from .session import ship
from .store import Store

MODEL = "hash-256"
TIES = ["file_key", "line_start", "chunk_ord"]


def _described(spark: SparkSession, text: str, run: Callable):
    """K6: a Spark job description for what a plan does."""
    spark.sparkContext.setJobDescription(text)
    try:
        return run()
    finally:
        spark.sparkContext.setJobDescription(None)


class CodeIndex:
    """``project`` is the folder that keys are relative to; ``folder`` holds the snapshots."""

    def __init__(self, spark: SparkSession, project: str | Path, folder: str | Path | None = None, global_config: str | Path | None = None) -> None:
        self.spark, self.project = ship(spark), Path(project).resolve()
        self.git_root = git.find_root(self.project)
        base = Path(folder) if folder else (self.git_root or self.project) / ".git" / "quarrylight"
        base.mkdir(parents=True, exist_ok=True)
        self.store = Store(spark, base)
        self.layers = [Path(global_config) if global_config else None, self.project / ".quarrylight" / "config.toml", base / "local.toml"]

    # -- configuration and sources

    def config(self) -> cfg.Config:
        return cfg.merge(*[cfg.load(p) if p else None for p in self.layers])

    def model(self) -> str:
        return self.config().embedding_model or MODEL

    def set_embedding_model(self, name: str, everywhere: bool = False) -> None:
        """U8: in the project's layer, or the global one."""
        path = self.layers[0] if everywhere else self.layers[1]
        if path is None:
            raise ValueError("no global configuration file was named")
        cfg.save(cfg.with_model(cfg.load(path) or cfg.Config(), name), path)

    def list_sources(self) -> DataFrame:
        return self._sources(cfg.resolved_sources(self.config(), self.project))

    def add_source(self, language: str, root: str, dep: bool = False, extensions: list[str] | None = None) -> None:
        path = self.layers[1]
        cfg.save(cfg.with_source(cfg.load(path) or cfg.Config(), cfg.Source(language, root, dep, tuple(extensions) if extensions else None)), path)

    def remove_source(self, index: int) -> None:
        path = self.layers[1]
        cfg.save(cfg.without_source(cfg.load(path) or cfg.Config(), index), path)

    def _sources(self, sources) -> DataFrame:
        rows = [(i, s.language, s.root, s.dep, list(s.extensions) if s.extensions is not None else None) for i, s in enumerate(sources)]
        return self.spark.createDataFrame(rows, schema.SOURCES)

    def _roots(self) -> dict[str, list[tuple[int, cfg.Source, str]]]:
        """The git roots or plain folders of the sources, each with its sources and their roots within it."""
        roots: dict[str, list] = {}
        for i, s in enumerate(cfg.resolved_sources(self.config(), self.project)):
            if s.dep:
                continue
            at = (self.project / s.root).resolve()
            own = git.find_root(at) if at.exists() else None
            home = own or at
            inside = at.relative_to(home).as_posix() if at != home else ""
            roots.setdefault(str(home), []).append((i, s, "" if inside == "." else inside))
        return roots

    # -- from paths to chunks

    def _owned(self, root: str, paths: DataFrame, sources: list) -> DataFrame:
        """The files among ``paths`` that a source owns."""
        rules = self.spark.createDataFrame([(root, i, s.language, inside, False, list(s.extensions) if s.extensions is not None else None) for i, s, inside in sources], "repo string, source_ord int, source_language string, root string, dep boolean, extensions array<string>")
        files = paths.select(F.lit(root).alias("repo"), "path")
        return discovered(claims(files, rules, "repo", "path"))

    def _texts(self, owned: DataFrame) -> DataFrame:
        """The texts of owned files; a file that is gone or isn't UTF-8 has none and drops out."""
        here = str(self.project)

        def read(batches):
            for b in batches:
                texts = []
                for root, path in zip(b["repo"], b["path"]):
                    try:
                        texts.append((Path(root) / path).read_text(encoding="utf-8"))
                    except (OSError, UnicodeDecodeError):
                        texts.append(None)
                whole = [str(Path(r) / p) for r, p in zip(b["repo"], b["path"])]
                keys = [w[len(here) + 1 :] if w.startswith(here + "/") else w for w in whole]
                yield b.assign(file_key=keys, text=texts)

        kinds = ", ".join(f"{c} {t}" for c, t in owned.dtypes)
        return owned.mapInPandas(read, f"{kinds}, file_key string, text string").where(F.col("text").isNotNull())

    def _indexed(self, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The chunk and file rows of owned files."""
        texts = cut(self._texts(owned))
        chunks = build.chunk_files(texts, ["file_key"], "file_key", "text", "language").drop("path")
        ords = texts.select(F.col("file_key").alias("__k"), "source_ord")
        chunks = chunks.join(ords, F.col("file_key") == F.col("__k")).drop("__k")
        chunks = chunks.withColumns({"origin": F.lit("Project"), "crate_name": F.lit(None).cast("string"), "crate_version": F.lit(None).cast("string"), "root_deps": F.lit(None).cast("array<string>")})
        chunks = cut(chunks)
        made = embedding.with_embeddings(chunks.select(F.col("file_key").alias("__k"), F.col("chunk_ord").alias("__o"), "embedding_text"), name=self.model()).select("__k", "__o", "embedding")
        chunks = chunks.join(made, (F.col("file_key") == F.col("__k")) & (F.col("chunk_ord") == F.col("__o")))  # texts alone go through Python
        columns = [c.split()[0] for c in schema.CHUNKS.split(", ")]
        files = texts.select("file_key", F.col("repo").alias("git_root"), "source_ord", "language")
        return chunks.select(*columns), files

    def _scan(self, root: str, sources: list) -> DataFrame:
        """Every path of a root."""
        if git.find_root(root) == Path(root):
            return git.tracked(self.spark, root).select("path")
        found = [p.relative_to(root).as_posix() for p in Path(root).rglob("*") if p.is_file() and not p.is_symlink()]
        return self.spark.createDataFrame([(x,) for x in found], "path string")

    # -- maintenance

    def refresh(self, force: bool = False) -> dict[str, DataFrame]:
        """Full without a fitting snapshot or when forced, else incremental; the current tables."""
        tables = None if force else self.store.load(self.model())
        if tables is None:
            return _described(self.spark, "rebuild index", self._rebuild)
        return _described(self.spark, "update index", lambda: self._update(tables))

    def _save(self, tables: dict[str, DataFrame], gone: DataFrame | None = None, fresh: DataFrame | None = None) -> dict[str, DataFrame]:
        """Whole tables, or with ``gone`` and ``fresh`` only the chunks that changed."""
        if gone is not None and fresh is not None:
            self.store.patch(tables, gone, fresh, self.model())
        else:
            self.store.save(tables, self.model())
        loaded = self.store.load(self.model())
        assert loaded is not None
        return loaded

    def _states(self, roots: list[str]) -> tuple[DataFrame, DataFrame]:
        """I8: commit and dirty files of the git roots."""
        states = [(r, git.head(r)) for r in roots]
        dirty = [git.dirty(self.spark, r).select(F.lit(r).alias("git_root"), "path", "sha256") for r in roots]
        return self.spark.createDataFrame(states, schema.GIT_STATES), reduce(DataFrame.unionByName, dirty, schema.empty(self.spark, schema.DIRTY))

    def _rebuild(self) -> dict[str, DataFrame]:
        """I2."""
        roots = self._roots()
        owned = [self._owned(r, self._scan(r, s), s) for r, s in roots.items()]
        if not owned:
            return self._save(self.store.empty())
        chunks, files = self._indexed(reduce(DataFrame.unionByName, owned))
        states, dirty = self._states([r for r in roots if git.find_root(r) == Path(r)])
        return self._save({"chunks": chunks, "files": files, "git_states": states, "dirty": dirty})

    def _update(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """What changed since the last state, root by root; files are re-read, chunks replaced."""
        roots = self._roots()
        before = {r["git_root"]: r["last_indexed_commit"] for r in tables["git_states"].collect()}  # one row a git root
        fresh: list[DataFrame] = []
        gone: list[DataFrame] = []
        states: list[str] = []
        for root, sources in roots.items():
            if git.find_root(root) != Path(root):  # I7: a plain folder is read once
                if not tables["files"].where(F.col("git_root") == root).limit(1).count():
                    fresh.append(self._owned(root, self._scan(root, sources), sources))
                continue
            states.append(root)
            if root not in before:  # I5
                fresh.append(self._owned(root, self._scan(root, sources), sources))
                continue
            old_dirty = tables["dirty"].where(F.col("git_root") == root)
            now_dirty = git.dirty(self.spark, root)
            commits = schema.empty(self.spark, "path string, change string")
            if git.head(root) != before[root]:
                try:
                    commits = git.committed(self.spark, root, before[root])
                except RuntimeError:  # I6: history was rewritten
                    gone.append(tables["files"].where(F.col("git_root") == root).select("file_key"))
                    fresh.append(self._owned(root, self._scan(root, sources), sources))
                    continue
            changed = maintenance.dirty_changed(now_dirty, old_dirty, ["path"])
            back = maintenance.reverted(old_dirty, now_dirty, commits, ["path"])
            reindex = maintenance.reindex_set(["path"], commits.where("change != 'deleted'"), changed, back)
            removed = maintenance.reindex_set(["path"], commits.where("change = 'deleted'"))
            touched = reindex.union(removed).distinct()
            gone.append(touched.select(self._key(root).alias("file_key")))
            fresh.append(self._owned(root, reindex, sources))
        gone.append(tables["files"].where(~F.col("git_root").isin(list(roots))).select("file_key"))  # roots that no source names any more
        head, dirty = self._states(states)
        affected = cut(reduce(DataFrame.union, gone, schema.empty(self.spark, "file_key string")).distinct())
        owned = cut(reduce(DataFrame.unionByName, fresh)) if fresh else None
        if owned is None or not owned.limit(1).count() and not affected.limit(1).count():
            if {tuple(r) for r in head.collect()} == set(before.items()):
                return tables
            self.store.keep_chunks(tables | {"git_states": head, "dirty": dirty}, self.model())
            return self.store.load(self.model()) or tables
        chunks, files = self._indexed(owned)
        drop = cut(affected.union(files.select("file_key")).distinct())
        return self._save({"files": maintenance.patched(tables["files"], drop, files, ["file_key"]), "git_states": head, "dirty": dirty}, drop, chunks)

    def _key(self, root: str):
        """A root's path as a key."""
        whole, here = F.concat(F.lit(root + "/"), F.col("path")), str(self.project)
        return F.when(whole.startswith(here + "/"), F.substr(whole, F.lit(len(here) + 2))).otherwise(whole)

    def rebuild_source(self, root: str) -> DataFrame:
        """Clears and reads one source again; ``files_indexed`` counts its files with chunks."""
        at = (self.project / root).resolve()
        chosen = [(home, x) for home, s in self._roots().items() for x in s if (Path(home) / x[2]).resolve() == at]
        if not chosen:
            raise ValueError(f"no source at {root}")
        tables = self.refresh()
        home, source = chosen[0]
        owned = self._owned(home, self._scan(home, [source]), [source])
        chunks, files = self._indexed(owned)
        drop = cut(tables["files"].where(F.col("source_ord") == source[0]).select("file_key").union(files.select("file_key")).distinct())
        saved = self._save(tables | {"files": maintenance.patched(tables["files"], drop, files, ["file_key"])}, drop, chunks)
        mine = saved["chunks"].where(F.col("source_ord") == source[0])
        return index_result(mine.select("file_key"), mine, ["file_key"])

    # -- queries

    def index(self, force: bool = True) -> DataFrame:
        """``files_indexed, chunks_created``."""
        tables = self.refresh(force)
        return index_result(tables["files"], tables["chunks"], ["file_key"])

    def search(self, text: str, k: int = 10) -> DataFrame:
        """The best chunks for a text; texts are read for the winners only."""
        chunks = self.refresh()["chunks"]
        narrow = chunks.select("file_key", "chunk_ord", "line_start", "line_end", "symbol_name", "origin", "crate_name", "embedding")
        best = ranking.search(narrow, embedding.embed_one(text, self.model()), text, k, TIES)
        winners = best.join(chunks.select(F.col("file_key").alias("__f"), F.col("chunk_ord").alias("__o"), "display_text", "embedding_text"), (F.col("file_key") == F.col("__f")) & (F.col("chunk_ord") == F.col("__o")))
        from ..functions.paths import extract_module

        return winners.select("rank", F.col("file_key").alias("file_path"), "line_start", "line_end", "score", "symbol_name", "origin", "crate_name", extract_module(F.col("embedding_text")).alias("module_path"), "display_text").orderBy("rank")

    def overview(self, file: str) -> str:
        """A file's overview; a file without one raises KeyError."""
        path = Path(file)
        if path.is_absolute():
            if not path.is_relative_to(self.project):
                raise ValueError(f"{file} is not below {self.project}")
            file = path.relative_to(self.project).as_posix()
        row = overviews(self.refresh()["chunks"].where(F.col("file_key") == file), ["file_key"], ["chunk_ord"]).first()
        if row is None:
            raise KeyError(f"no overview of {file}")
        return row["overview"]

    def dep_overview(self, name: str) -> str:
        """The overview of a dependency's chunks, as far as the table holds any; none raises KeyError."""
        mine = self.refresh()["chunks"].where((F.lower("origin") == "dependency") & (F.col("crate_name") == name))
        row = overviews(mine, ["crate_name"], ["file_key", "chunk_ord"]).first()
        if row is None:
            raise KeyError(f"no dependency {name}")
        return row["overview"]


def as_dict(source: cfg.Source) -> dict:
    return asdict(source)
