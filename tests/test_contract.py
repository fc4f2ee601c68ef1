"""The driver's contract: queries and their SQL, with and without the text operators."""

import subprocess
import sys
import textwrap
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_is_callable():
    names = __spark_entry__.queries()
    assert all(callable(f) for f in names.values()) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert len(__spark_entry__.oracle_sql()) >= 95


def test_without_text_operators():
    """The rest imports and lists its queries when the text operators, or what they need, are missing."""
    code = textwrap.dedent(
        """
        import sys
        class Missing:
            def find_spec(self, name, path=None, target=None):
                if name.split(".")[0] in ("xxhash", "zstandard", "tokenizers", "tiktoken") or name.startswith("locusmill.llm"):
                    raise ImportError(name)
        sys.meta_path.insert(0, Missing())
        import __spark_entry__ as e
        names = e.queries()
        assert "score_matrix" in names and "mate_position" in names and not any(n.startswith("op1_") or n == "pipeline" for n in names)
        assert set(e.oracle_sql()) <= set(names)
        """
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
