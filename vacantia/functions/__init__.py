"""Column-to-column building blocks; everything here stays on the JVM side."""
