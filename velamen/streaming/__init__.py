"""The same plans over streams of files."""
