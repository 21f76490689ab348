"""Folders and marker files of the store that Spark itself reads, through Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Names, markers and moves below one folder; content stays with Spark's readers and writers."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = "") -> str:
        """Full path of a name below the folder."""
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._path(self.path(name)))

    def names(self, name: str = "") -> list[str]:
        """Names directly below a folder, none where it is absent."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(self.path(name))))

    def files(self) -> list[tuple[str, str, int]]:
        """Name below the folder, full path and size of every file; bookkeeping names (``.`` or ``_``) are left out."""
        root = self._files.getFileStatus(self._path(self.root)).getPath().toString().rstrip("/")
        found, listing = [], self._files.listFiles(self._path(self.root), True)
        while listing.hasNext():
            status = listing.next()
            place = status.getPath().toString()
            name = place[len(root) + 1 :] or place.rsplit("/", 1)[-1]
            if not any(part[0] in "._" for part in name.split("/")):
                found.append((name, place, status.getLen()))
        return sorted(found)

    def delete(self, name: str) -> None:
        self._files.delete(self._path(self.path(name)), True)

    def mark(self, name: str) -> bool:
        """Create an empty file; false if it was there, so only one caller gets true."""
        place = self._path(self.path(name))
        self._files.mkdirs(place.getParent())
        return self._files.createNewFile(place)

    def move(self, name: str, target: str) -> bool:
        """Rename inside the folder; false if the target was there."""
        place = self._path(self.path(target))
        self._files.mkdirs(place.getParent())
        return not self._files.exists(place) and self._files.rename(self._path(self.path(name)), place)


def finished_folders(store: Store, folder: str, prefix: str) -> list[tuple[int, ...]]:
    """Numbers of the folders ``prefix=a.b...`` below ``folder`` whose write has finished, ascending."""
    found = [n for n in store.names(folder) if n.startswith(f"{prefix}=")]
    return sorted(tuple(map(int, n.split("=")[1].split("."))) for n in found if store.exists(f"{folder}/{n}/_SUCCESS"))
