"""Column expressions: boxes, angles, display, placement, policy. All stay inside Catalyst."""
