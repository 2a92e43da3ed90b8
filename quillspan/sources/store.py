"""Objects under a root folder: staged commits, create-only writes, compare-and-swap of pointers.

Keys are relative paths; what would leave the root (absolute, ``..``, through a
symbolic link) is refused. Pointers and manifests are small files that the driver
writes; tables are written by Spark under keys of their own and never changed.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from pathlib import Path, PurePosixPath

from quillspan.functions.hashing import fnv1a_bytes
from quillspan.model import OperationError

SCHEME = "s3://"
#: A lock of this age has no owner any more.
LOCK_SECONDS = 60.0


class Store:
    def __init__(self, root: str | Path):
        self.root = Path(root).resolve()
        self.root.mkdir(parents=True, exist_ok=True)

    def path(self, key: str) -> Path:
        parts = PurePosixPath(key)
        if not key or parts.is_absolute() or any(p in ("", ".", "..") for p in key.split("/")):
            raise OperationError(f"unsafe key: {key}")
        out = (self.root / parts).resolve()
        if out == self.root or self.root not in out.parents:
            raise OperationError(f"key leaves the store: {key}")
        return out

    def resolve(self, uri: str) -> Path:
        """The local path of s3://bucket/key, the bucket being this store."""
        bucket, _, key = uri.removeprefix(SCHEME).partition("/")
        if not uri.startswith(SCHEME) or not bucket or not key:
            raise OperationError(f"not a store address: {uri}")
        return self.path(key)

    def check_tree(self, folder: Path) -> None:
        """All of a folder must lie within the root, without cycles of links."""
        if not folder.is_dir():
            raise OperationError(f"artifact folder is missing: {folder}")
        seen: set[Path] = set()
        for here, names, files in os.walk(folder, followlinks=True):
            real = Path(here).resolve()
            if real in seen:
                raise OperationError(f"cycle of links at {here}")
            seen.add(real)
            for name in [*names, *files]:
                target = (Path(here) / name).resolve()
                if self.root not in target.parents:
                    raise OperationError(f"{Path(here) / name} leads outside the store")

    def read(self, key: str) -> bytes | None:
        try:
            return self.path(key).read_bytes()
        except FileNotFoundError:
            return None

    def create(self, key: str, data: bytes) -> None:
        """Fails if the key is there."""
        path = self.path(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        try:
            with path.open("xb") as f:
                f.write(data)
        except FileExistsError as error:
            raise OperationError(f"{key} exists already", "publish_error") from error

    def overwrite(self, key: str, data: bytes) -> None:
        path = self.path(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        fresh = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
        fresh.write_bytes(data)
        os.replace(fresh, path)

    @staticmethod
    def etag(data: bytes | None) -> str | None:
        return None if data is None else f"{fnv1a_bytes(data):016x}"

    @contextmanager
    def _locked(self, key: str, patience: float = 10.0):
        lock = self.path(key).with_name(f".{Path(key).name}.lock")
        lock.parent.mkdir(parents=True, exist_ok=True)
        until = time.monotonic() + patience
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                self._expire(lock)
                if time.monotonic() > until:
                    raise OperationError(f"{key} is locked") from None
                time.sleep(0.01)
        try:
            yield
        finally:
            lock.unlink(missing_ok=True)

    @staticmethod
    def _expire(lock: Path) -> None:
        """Removes a lock that its process has left behind; a swap takes milliseconds."""
        try:
            left = lock.stat()
            if time.time() - left.st_mtime > LOCK_SECONDS:
                aside = lock.with_name(f"{lock.name}-{uuid.uuid4().hex}")
                os.rename(lock, aside)  # of several that try, one succeeds
                aside.unlink()
        except FileNotFoundError:
            pass

    def compare_and_swap(self, key: str, expected: str | None, data: bytes) -> bool:
        """Writes a pointer if its tag is still the expected one (None: absent)."""
        with self._locked(key):
            if self.etag(self.read(key)) != expected:
                return False
            self.overwrite(key, data)
            return True

    def commit_staged(self, moves: Iterable[tuple[Path, str]]) -> None:
        """Renames finished folders or files into place, all or none; what is there is never replaced."""
        done: list[tuple[Path, Path]] = []
        try:
            for source, key in moves:
                target = self.path(key)
                if target.exists():
                    raise OperationError(f"{key} exists already", "publish_error")
                target.parent.mkdir(parents=True, exist_ok=True)
                os.rename(source, target)
                done.append((target, source))
        except BaseException:
            for target, source in reversed(done):
                os.rename(target, source)
            raise

    def replace_folder(self, source: Path, key: str) -> None:
        """Puts a finished folder in another's place; the old one comes back if that fails."""
        target = self.path(key)
        target.parent.mkdir(parents=True, exist_ok=True)
        aside = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
        had = target.exists()
        if had:
            os.rename(target, aside)
        try:
            os.rename(source, target)
        except BaseException:
            if had:
                os.rename(aside, target)
            raise
        if had:
            shutil.rmtree(aside) if aside.is_dir() else aside.unlink()

    def staging(self) -> Path:
        path = self.root / f".staging-{uuid.uuid4().hex}"
        path.mkdir(parents=True)
        return path
