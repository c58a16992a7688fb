"""Paths that never enter a corpus."""

from lakeloom.functions import text as T
from tests.llm.conftest import spark  # noqa: F401

EXTENSIONS = "exe com scr dll dylib so app msi msp bat cmd ps1 sh bash zsh fish command vbs vbe js jse mjs cjs wsf wsh hta jar class wasm apk deb rpm dmg pkg key pem p12 pfx".split()
NAMES = [".git/config", ".obsidian/app", ".DS_Store", ".env", ".env.local", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", "credentials.json", ".npmrc", ".pypirc", ".netrc", "secrets.yaml"]
DENIED = [*(f"a/b.{e}" for e in EXTENSIONS), *(f"a/b.{e.upper()}" for e in EXTENSIONS), *NAMES, *(f"a/{n.upper()}" for n in NAMES), "http://h.example.com/a/x.JS?v=1#top", "https://h.example.com/.env"]
KEPT = ["a/b.md", "a/b.json", "a.js/b.md", ".js", "a/.key", "environment", "my_id_rsa", "credentials.txt", "xsecrets.yaml", "http://h.example.com", "http://h.com/", "http://h.com?x=a.js", "notes.jsx", ""]


def test_is_excluded(spark):  # noqa: F811
    assert len(EXTENSIONS) == 38
    df = spark.createDataFrame([(p, True) for p in DENIED] + [(p, False) for p in KEPT], "path string, want boolean")
    assert [r.path for r in df.where(T.is_excluded(df.path) != df.want).collect()] == []
