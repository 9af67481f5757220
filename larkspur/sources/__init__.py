"""Sources: trees of files, git, chat stores, reports."""
