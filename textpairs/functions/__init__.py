"""Row-local column expressions; all of them also work on streaming frames."""
