"""guardlake: guard and decision analytics over tables and streams of AI traffic."""
