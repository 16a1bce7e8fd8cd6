"""Sources: readers of tabular, geographic and codebook files, and paged services."""
