"""A queue of build jobs with leases, retries and dead letters, in one small database.

Claiming reclaims leases that ran out, then takes all ready jobs, each under a
token of its own; acknowledging or returning a job works only with the token of
the last claim. Attempts back off linearly; the last one moves a job to the dead
letters. Enqueueing a known batch resets it.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from quillspan.sources.wal import now_millis

LEASE_MS, MAX_ATTEMPTS, BACKOFF_MS = 300_000, 3, 1000


@dataclass(frozen=True)
class Job:
    token: str
    body: str


class JobQueue:
    def __init__(self, path: str | Path, clock: Callable[[], int] = now_millis):
        self.clock = clock
        self.db = sqlite3.connect(str(path), isolation_level=None, timeout=30)
        self.db.executescript(
            """CREATE TABLE IF NOT EXISTS job(batch TEXT PRIMARY KEY, body TEXT NOT NULL, attempts INT NOT NULL, ready_at INT NOT NULL, token TEXT, claimed_at INT);
            CREATE TABLE IF NOT EXISTS dead(batch TEXT PRIMARY KEY, body TEXT NOT NULL, attempts INT NOT NULL, error TEXT, died_at INT)"""
        )

    def _within(self, work: Callable[[], list]) -> list:
        self.db.execute("BEGIN IMMEDIATE")
        try:
            out = work()
        except BaseException:
            self.db.execute("ROLLBACK")
            raise
        self.db.execute("COMMIT")
        return out

    def enqueue(self, batch: str, body: str) -> None:
        self.db.execute("INSERT OR REPLACE INTO job VALUES (?, ?, 0, ?, NULL, NULL)", (batch, body, self.clock()))

    def receive(self) -> list[Job]:
        now = self.clock()

        def work() -> list[Job]:
            self.db.execute("UPDATE job SET token = NULL, claimed_at = NULL WHERE claimed_at <= ?", (now - LEASE_MS,))
            ready = self.db.execute("SELECT batch, body FROM job WHERE token IS NULL AND ready_at <= ? ORDER BY batch", (now,)).fetchall()
            jobs = [Job(uuid.uuid4().hex, body) for _, body in ready]
            self.db.executemany("UPDATE job SET token = ?, claimed_at = ? WHERE batch = ?", [(j.token, now, b) for j, (b, _) in zip(jobs, ready, strict=True)])
            return jobs

        return self._within(work)

    def ack(self, job: Job) -> None:
        self.db.execute("DELETE FROM job WHERE token = ?", (job.token,))

    def nack(self, job: Job, error: str) -> None:
        now = self.clock()

        def work() -> list:
            found = self.db.execute("SELECT batch, attempts + 1 FROM job WHERE token = ?", (job.token,)).fetchone()
            if found is None:  # a late return of a job that another worker holds
                return []
            batch, attempts = found
            if attempts >= MAX_ATTEMPTS:
                self.db.execute("INSERT OR REPLACE INTO dead SELECT batch, body, ?, ?, ? FROM job WHERE batch = ?", (attempts, error, now, batch))
                self.db.execute("DELETE FROM job WHERE batch = ?", (batch,))
            else:
                self.db.execute("UPDATE job SET attempts = ?, ready_at = ?, token = NULL, claimed_at = NULL WHERE batch = ?", (attempts, now + BACKOFF_MS * attempts, batch))
            return []

        self._within(work)

    def dead(self) -> list[tuple[str, int, str]]:
        return self.db.execute("SELECT batch, attempts, error FROM dead ORDER BY batch").fetchall()
