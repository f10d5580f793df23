import os

# tests run each plan once or twice: quick compilation is worth more than fast code
os.environ.setdefault("JDK_JAVA_OPTIONS", "-XX:TieredStopAtLevel=1")

import pytest  # noqa: E402

from gridloom.cluster import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """A function that writes bytes to a file in a fresh folder and gives its path."""

    def write(name: str, content: str | bytes, encoding: str = "utf-8") -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        data = content if isinstance(content, bytes) else content.encode(encoding)
        path.write_bytes(data)
        return str(path)

    write.root = str(tmp_path)
    write.new = lambda name: os.path.join(str(tmp_path), name)
    return write


def rows(df):
    """Rows as plain tuples, in a repeatable order."""
    return sorted(map(tuple, df.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
