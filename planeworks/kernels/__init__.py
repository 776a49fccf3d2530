"""Array kernels in numpy for what relational operators cannot express: each works on one plane or tile."""
