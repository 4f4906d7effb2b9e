from tracecairn.streaming.descriptors import DescriptorStream
from tracecairn.streaming.events import BucketStream, bucket_stats_stream, stream_events

__all__ = ["BucketStream", "DescriptorStream", "bucket_stats_stream", "stream_events"]
