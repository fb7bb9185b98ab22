"""Rule pack, written tables and the whole analysis."""
