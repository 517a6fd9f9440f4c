"""DataFrame-to-DataFrame operators over keyed series."""
