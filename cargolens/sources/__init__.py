"""Reading and writing: raw CSV, the trade lake, the rollup, references, exports."""
