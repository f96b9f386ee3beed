"""Writers: each gives the lines (or binary rows) of its format as a DataFrame; write_lines and write_blobs put them into files."""
